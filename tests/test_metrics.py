"""Curves and metrics against plain Python, including ties and one-class groups."""

import random

import pytest
from pyspark.sql import functions as F

from dueday.operators import curves, metrics, models, reports

SCHEMA = "g string, label int, y_prob double"


def scores(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randint(0, 1), rng.randint(0, 40) / 40) for _ in range(n)]


def brute_auc(rows):
    pos = [p for _, y, p in rows if y]
    neg = [p for _, y, p in rows if not y]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total = sum(y for _, y, _ in rows)
    if not total:
        return None
    ap, last = 0.0, 0.0
    for t in sorted({p for _, _, p in rows}, reverse=True):
        above = [y for _, y, p in rows if p >= t]
        ap += (sum(above) / total - last) * sum(above) / len(above)
        last = sum(above) / total
    return ap


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_areas_equal_brute_force(spark, many_parts, seed):
    rows = scores(seed)
    got = {r.g: r for r in curves.curve_areas(curves.pr_curve(spark.createDataFrame(rows, SCHEMA), ["g"]), ["g"]).collect()}
    for g in "ab":
        mine = [r for r in rows if r[0] == g]
        assert got[g].roc_auc == pytest.approx(brute_auc(mine))
        assert got[g].pr_auc == pytest.approx(brute_ap(mine))


def test_curve_spans_several_parts(spark, many_parts):
    df = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 5000).alias("y_prob"))
    counts = curves.score_counts(df, ["g"])
    assert curves.ordered_parts(counts, ["g", F.desc("score")]).select("part").distinct().count() > 1
    assert curves.roc_auc(df, ["g"]).first().roc_auc == pytest.approx(0.5002)


def test_one_class_groups(spark):
    df = spark.createDataFrame([("a", 0, 0.3), ("a", 0, 0.4), ("b", 1, 0.2), ("b", 1, 0.9)], SCHEMA)
    got = {r.g: (r.roc_auc, r.pr_auc) for r in curves.curve_areas(curves.pr_curve(df, ["g"]), ["g"]).collect()}
    assert got == {"a": (None, None), "b": (None, 1.0)}


def test_best_f1_takes_the_lowest_score_on_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("a", 0, 0.7), ("a", 1, 0.1)], SCHEMA)
    got = curves.best_f1_threshold(df, ["g"]).first()
    assert got.optimal_threshold == 0.1  # 2/3 at 0.9 and at 0.1


def test_exact_median(spark, many_parts):
    rows = [("odd", float(v)) for v in (5, 1, 9)] + [("even", float(v)) for v in (1, 1, 4, 10)] + [("even", None)]
    got = {r.c: r.median for r in curves.exact_median(spark.createDataFrame(rows, "c string, v double"), ["c"], "v").collect()}
    assert got == {"odd": 5.0, "even": 2.5}


def test_undefined_is_zero_in_training_metrics(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2)], SCHEMA)
    got = metrics.classification_metrics(df, ["g"]).first()
    assert (got.precision, got.recall, got.f1, got.balanced_accuracy) == (0.0, 0.0, 0.0, 0.5)


def slices(rows):
    return [("t", "m", c, y, p, int(p >= 0.5)) for c, y, p in rows]


SLICED = "target string, model string, CODE_GENDER string, label int, y_prob double, y_pred_optimal int"


def test_undefined_is_null_in_group_metrics(spark):
    df = spark.createDataFrame(slices([("F", 0, 0.1), ("F", 1, 0.2), ("M", 0, 0.9), (None, 1, 0.9)]), SLICED)
    got = {r.group: r for r in metrics.group_metrics(df, ["CODE_GENDER"], 1).collect()}
    assert set(got) == {"F", "M"}
    assert (got["F"].precision, got["F"].f1, got["F"].tpr) == (None, 0.0, 0.0)
    assert (got["M"].tpr, got["M"].fnr, got["M"].fpr, got["M"].roc_auc, got["M"].brier) == (None, None, 1.0, None, None)


def test_fairness_is_against_the_whole_population(spark):
    df = spark.createDataFrame(slices([("F", 1, 0.9), ("F", 0, 0.1), ("M", 1, 0.9), ("M", 0, 0.9)]), SLICED)
    got = {r.group: r for r in metrics.fairness_metrics(df, ["CODE_GENDER"], 1).collect()}
    assert got["F"].disparate_impact_ratio == pytest.approx(0.5 / 0.75)
    assert got["M"].fpr_gap_vs_overall == pytest.approx(0.5)


def test_small_groups_are_dropped(spark):
    df = spark.createDataFrame(slices([("F", 1, 0.9)] * 3 + [("M", 0, 0.1)] * 2), SLICED)
    assert [r.group for r in metrics.harm_analysis(df, ["CODE_GENDER"], 3).collect()] == ["F"]


def test_error_rates_of_one_class_overall(spark):
    df = spark.createDataFrame(slices([("F", 0, 0.9), ("F", 0, 0.1)]), SLICED)
    got = metrics.fp_fn_by_slice(df, ["CODE_GENDER"], 1).collect()
    assert [(r.slice_col, r.fpr, r.fnr, r.recall) for r in got] == [("overall", 0.5, 0.0, 0.0)]


def test_calibration_edges(spark):
    rows = [("t", "m", 0, 0.0), ("t", "m", 0, 0.1), ("t", "m", 1, 0.10000001), ("t", "m", 1, 1.0)]
    df = spark.createDataFrame(rows, "target string, model string, label int, y_prob double")
    got = [(r.bin, r.true_bin, r.actual_positive_rate) for r in metrics.calibration_curve(df).orderBy("bin").collect()]
    assert got == [(0, 0, 0.0), (1, 1, 1.0), (2, 9, 1.0)]


def test_thresholds_include_the_best(spark):
    got = metrics.fixed_threshold_metrics(spark.createDataFrame(scores(4), SCHEMA), ["g"]).where("g = 'a'").collect()
    assert len(got) == 5 and max(got, key=lambda r: r.f1).threshold_type == "optimal_f1"


def test_best_model_and_gap(spark):
    df = spark.createDataFrame(
        [("t", "rf", "test", 0.7), ("t", "gb", "test", 0.8), ("t", "rf", "validation", 0.9)],
        "target string, model string, split string, roc_auc double",
    )
    assert reports.best_model_per_target(df).first().model == "gb"
    fed = spark.createDataFrame(
        [("t", "rf", "centralized", 0.8), ("t", "rf", "federated", 0.7), ("t", "rf", "local", 0.6), ("t", "rf", "local", 0.5)],
        "target string, model string, federation string, roc_auc double",
    )
    got = reports.federation_gap(fed).first()
    assert (got.local_best_roc_auc, got.local_worst_roc_auc, round(got.gap, 6)) == (0.6, 0.5, -0.1)


def test_average_over_models(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4), (2, 0.5)], "k int, y_prob double")
    assert {r.k: round(r.y_prob, 9) for r in models.ensemble_average(df, ["k"]).collect()} == {1: 0.3, 2: 0.5}
