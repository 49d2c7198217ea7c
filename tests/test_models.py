"""Preparation, training, parts and attributions on a learnable toy table."""

import hashlib
from itertools import combinations
from math import factorial

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dueday.catalog import training
from dueday.catalog.base import result
from dueday.functions import trees
from dueday.functions.trees import tree_shapley
from dueday.operators import curves, explain, models, prepare
from dueday.plans.stages import TARGETS, tuned_thresholds
from dueday.session import materialize, scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1200).select(
        F.concat(F.lit("s"), "id").alias("snapshot_id"),
        F.when(F.col("id") % 11 != 0, F.rand(1)).alias("a"),
        (F.col("id") % 7).cast("double").alias("b"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("c"),
    )
    label = (F.coalesce("a", F.lit(0.0)) > 0.55) & (F.col("b") < 5) & (F.rand(3) < 0.9)
    return materialize(df.withColumn("label", label.cast("int")), "toy")


@pytest.fixture(scope="module")
def pre(rows):
    return prepare.fit_preprocessor(rows, ["a", "b"], ["c"])


@pytest.fixture(scope="module")
def prepared(rows, pre):
    return materialize(pre.transform(rows, ["snapshot_id", "label"]), "toy-prepared")


@pytest.fixture(scope="module")
def forest(prepared):
    return models.train_rf(prepared, numTrees=6, maxDepth=4, minInstancesPerNode=5)


@pytest.fixture(scope="module")
def boosted(prepared):
    return models.fit_gb(prepared, maxIter=6, maxDepth=3)


def test_preprocessor(spark, rows, pre):
    a = [r.a for r in rows.where("a IS NOT NULL").select("a").collect()]
    assert pre.medians["a"] == pytest.approx(float(np.median(a)))
    assert [tuple(r) for r in pre.codes.orderBy("code").collect()] == [("c", "c0", 0), ("c", "c1", 1), ("c", "c2", 2)]
    counts = {r.c: r["count"] for r in rows.where("c IS NOT NULL").groupBy("c").count().collect()}
    assert pre.modes["c"] == min(counts, key=lambda k: (-counts[k], k))
    new = spark.createDataFrame([("x", None, 1.0, "new", 0), ("y", 0.5, None, None, 0)], "snapshot_id string, a double, b double, c string, label int")
    got = [list(r.features) for r in pre.transform(new, ["snapshot_id"]).orderBy("snapshot_id").collect()]
    assert got[0] == [pre.medians["a"], 1.0, -1.0]
    assert got[1] == [0.5, 3.0, float(["c0", "c1", "c2"].index(pre.modes["c"]))]


def test_preprocessor_is_saved(spark, pre, rows):
    path = scratch_path(spark, "pre")
    pre.save(path)
    again = prepare.Preprocessor.load(spark, path)

    def features(p):
        return sorted((r.snapshot_id, tuple(r.features)) for r in p.transform(rows, ["snapshot_id"]).collect())

    assert features(again) == features(pre)


@pytest.mark.parametrize("sketch", [5, 50, 10_000])
def test_medians_by_bracket(spark, many_parts, sketch):
    """Ties, infinities, even and odd counts, missing values, a column without any; a coarse sketch is widened."""
    df = spark.range(999).select(
        ((F.col("id") * 7919) % 1000).cast("double").alias("spread"), (F.col("id") % 2).alias("two"), F.lit(4).alias("one"),
        F.when(F.col("id") < 500, F.col("id")).alias("half"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") == 5, float("inf")).when(F.col("id") == 6, float("-inf")).when(F.col("id") < 9, -F.col("id")).alias("few"),
    ).repartition(7)
    got = {r.column_name: r.median for r in prepare.exact_medians(df, df.columns, sketch).collect()}
    values = {c: [float(r[0]) for r in df.select(c).where(F.col(c).isNotNull()).collect()] for c in df.columns}
    assert got == {c: float(np.median(v)) if v else None for c, v in values.items()}


def test_medians_of_an_empty_table(spark):
    assert [r.median for r in prepare.exact_medians(spark.createDataFrame([], "a double, b int"), ["a", "b"]).collect()] == [None, None]


def test_bounded_median(rows):
    got = prepare.impute_median(rows, ["b"], accuracy=1000).first()
    assert abs(got.median - 3.0) <= 1


@pytest.mark.parametrize("small", [100_000, 10])
def test_many_categories(spark, many_parts, monkeypatch, small):
    """200,000 categories, one of them with a third of the rows, and rows without any; joined either way."""
    monkeypatch.setattr(prepare, "SMALL_CODES", small)
    rows = spark.range(300_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("c"), F.col("id").cast("string"))).alias("c"))
    pre = prepare.fit_preprocessor(rows, [], ["c"])
    assert pre.sizes["c"] > 190_000 and pre.modes == {"c": "hot"}
    new = rows.union(spark.createDataFrame([(-1, "unseen")], "id long, c string"))
    got = pre.filled(new, ["id"])
    want = pre.codes.select(F.col("category").alias("c"), "code")
    both = got.join(new.withColumn("c", F.coalesce("c", F.lit("hot"))), "id").join(want, "c", "left")
    assert both.count() == 300_001 and both.where("x_c <> coalesce(code, -1)").count() == 0
    assert got.where("id = -1").first().x_c == -1.0


@pytest.mark.parametrize("name", ["forest", "boosted"])
def test_models_learn(request, prepared, name):
    scored = models.score(request.getfixturevalue(name), prepared).withColumn("g", F.lit(1))
    assert curves.roc_auc(scored, ["g"]).first().roc_auc > 0.9


def test_training_needs_both_classes(prepared):
    with pytest.raises(ValueError, match="both classes"):
        models.train_rf(prepared.where("label = 0"))


def test_staged_margins_are_the_models_margins(spark, boosted, prepared):
    total = boosted.getNumTrees
    leaves = models.staged_leaves(boosted, prepared, ["snapshot_id", "label"])
    margins = models.staged_margins(leaves, models.leaf_values(boosted, spark), 2, total)
    assert margins.count() == (total - 1) * prepared.count()
    for rounds in (2, total):
        mine = {r.snapshot_id: r.margin for r in margins.where(F.col("rounds") == rounds).collect()}
        cut = models.prefix_model(boosted, rounds, spark)
        theirs = {r[0]: r[1] for r in cut.transform(prepared).select("snapshot_id", vector_to_array("rawPrediction")[1]).collect()}
        assert cut.getNumTrees == rounds and mine == pytest.approx(theirs)


def test_choose_rounds():
    history = [(10, 0.1), (20, 0.3), (30, 0.2), (40, 0.29), (50, 0.25), (80, 0.9)]
    assert models.choose_rounds(history, patience=30) == 20
    assert models.choose_rounds(history, patience=100) == 80


def test_early_stopping(spark, prepared):
    """The chosen round, from written margins, by SQL; rounds after the patience are not judged."""
    model, history = models.train_gb(prepared, prepared, maxIter=6, maxDepth=2, patience=2)
    judged = {r.rounds: r.pr_auc for r in history.collect()}
    best = model.getNumTrees
    assert best == models.choose_rounds(list(judged.items()), 2) and max(judged) < best + 4
    full = models.fit_gb(prepared, maxIter=6, maxDepth=2)
    path = scratch_path(spark, "margins")
    models.staged_margins(models.staged_leaves(full, prepared), models.leaf_values(full, spark), 1, 6).write.parquet(path)
    sql = f"""WITH m AS (SELECT rounds, margin, sum(label) AS tp, count(*) AS n FROM '{path.removeprefix("file:")}/*.parquet' GROUP BY 1, 2),
        c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY rounds) AS p FROM m WINDOW w AS (PARTITION BY rounds ORDER BY margin DESC))
        SELECT rounds, sum(tp / p * ctp / cn) FROM c GROUP BY 1"""
    twin = dict(duckdb.sql(sql).fetchall())
    assert all(judged[r] == pytest.approx(twin[r]) for r in judged)


def test_rounds_are_fitted_as_long_as_they_may_gain(spark, prepared, monkeypatch):
    """The model is the one that all rounds would give, without fitting all of them."""
    fitted, fit = [], models.fit_gb
    monkeypatch.setattr(models, "fit_gb", lambda *a, **p: fitted.append(p["maxIter"]) or fit(*a, **p))
    scores = {1: 0.3, 2: 0.2, 3: 0.4, 4: 0.5, 5: 0.1, 6: 0.1, 7: 0.9}
    judged = spark.createDataFrame([], "rounds int, pr_auc double")

    def judge(margins, by, score):
        own = [r.rounds for r in margins.select("rounds").distinct().collect()]
        return judged.union(spark.createDataFrame([(r, scores[r]) for r in own], judged.schema))

    monkeypatch.setattr(models, "average_precision", judge)
    model, history = models.train_gb(prepared, prepared, maxIter=40, maxDepth=2, patience=2)
    assert fitted == [4, 8] and model.getNumTrees == 4
    assert sorted(r.rounds for r in history.collect()) == [1, 2, 3, 4, 5, 6]
    whole = models.prefix_model(fit(prepared, maxIter=8, maxDepth=2), 4, spark)
    assert model.toDebugString.split("\n")[1:] == whole.toDebugString.split("\n")[1:]


def test_boosting_on_parts_shares_the_pooled_weight(prepared):
    parted = materialize(models.stratified_partition(prepared, 2), "toy-parts")
    local = models.train_parts_gb(parted, 2, maxIter=3, maxDepth=2)
    weight = models.weight_column(prepared, balanced=False)
    alone = models.fit_gb(parted.where("part = 1"), weight, maxIter=3, maxDepth=2)
    assert [m.getNumTrees for m in local] == [3, 3] and alone.toDebugString.split("\n")[1:] == local[1].toDebugString.split("\n")[1:]


def test_model_store(spark, forest, prepared):
    path = scratch_path(spark, "store")
    calls = []

    def fit():
        calls.append(1)
        return forest

    for retrain in (False, False, True):
        got = models.model_store(path, RandomForestClassificationModel, fit, retrain, {"numTrees": 6}, "v1")
    assert len(calls) == 2 and got.getNumTrees == forest.getNumTrees
    models.model_store(path, RandomForestClassificationModel, fit, False, {"numTrees": 7}, "v1")
    models.model_store(path, RandomForestClassificationModel, fit, False, {"numTrees": 6}, "v2")
    assert len(calls) == 4  # other settings or another input train anew


def test_parts_are_balanced(prepared):
    got = models.stratified_partition(prepared, 5, buckets=7).groupBy("label", "part").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in got if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert sum(r["count"] for r in got) == prepared.count()


def test_parts_do_not_depend_on_layout(prepared):
    def parts(df):
        return {r.snapshot_id: r.part for r in models.stratified_partition(df, 3).collect()}

    assert parts(prepared) == parts(prepared.repartition(7))


def test_average_of_parts(prepared, forest):
    parted = materialize(models.stratified_partition(prepared, 2), "toy-parts")
    local = models.train_parts_rf(parted, 2, numTrees=4, maxDepth=3, minInstancesPerNode=5)
    assert [m.getNumTrees for m in local] == [2, 2]
    got = models.federated_scores(forest, local, prepared, ["snapshot_id", "label"])
    wide = got.groupBy("snapshot_id").pivot("client", ["all", "client_1", "client_2"]).agg(F.collect_list("y_prob"))
    both = got.where("federation = 'federated'").select("snapshot_id", F.col("y_prob").alias("mean"))
    for r in wide.join(both, "snapshot_id").limit(50).collect():
        assert r["mean"] == pytest.approx((r["client_1"][0] + r["client_2"][0]) / 2)
    table = models.federated_comparison(
        got.withColumns({"target": F.lit("t"), "model": F.lit("rf"), "threshold": F.lit(0.5)})
    )
    assert {(r.federation, r.client) for r in table.collect()} == {
        ("centralized", "all"), ("federated", "all"), ("local", "client_1"), ("local", "client_2")}


@pytest.mark.parametrize("name, column", [("forest", "probability"), ("boosted", "rawPrediction")])
def test_attributions_add_up(request, prepared, name, column):
    model = request.getfixturevalue(name)
    got = explain.tree_attribution(model, prepared, n_rows=20)
    sums = {r.snapshot_id: r.s for r in got.groupBy("snapshot_id").agg(F.sum("attribution").alias("s")).collect()}
    assert len(sums) == 20
    out = model.transform(prepared).select("snapshot_id", vector_to_array(column)[1].alias("v")).collect()
    for r in out:
        if r.snapshot_id in sums:
            assert sums[r.snapshot_id] == pytest.approx(r.v, abs=1e-9)


@pytest.mark.parametrize("name, column", [("forest", "probability"), ("boosted", "rawPrediction")])
def test_attributions_of_all_rows(request, prepared, name, column):
    model = request.getfixturevalue(name)
    got = materialize(explain.tree_attribution(model, prepared, n_rows=None), "toy-attributions")
    sums = {r.snapshot_id: r.s for r in got.groupBy("snapshot_id").agg(F.sum("attribution").alias("s")).collect()}
    out = model.transform(prepared).select("snapshot_id", vector_to_array(column)[1].alias("v")).collect()
    assert {r.snapshot_id: r.v for r in out} == pytest.approx(sums, abs=1e-9) and len(sums) == 1200
    some = explain.tree_attribution(model, prepared, n_rows=20).collect()
    every = {(r.snapshot_id, r.feature_index): r.attribution for r in got.collect()}
    assert all(every.get((r.snapshot_id, r.feature_index), 0.0) == pytest.approx(r.attribution, abs=1e-9) for r in some)


def test_unused_feature_has_no_importance(forest, prepared, pre):
    got = explain.tree_attribution(forest, prepared, n_rows=10)
    mean = explain.mean_abs_attribution(got, [*pre.feature_names, "never"])
    ranked = explain.attribution_ranking(mean, "t", "rf", k=3).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3]
    assert mean.where("feature = 'never'").first().mean_abs_shap == 0.0
    assert {ranked[0].feature, ranked[1].feature} == {"a", "b"}


@pytest.mark.parametrize("most", [16, 0])
def test_shapley_values_equal_the_definition(monkeypatch, most):
    """Two features, one of them tested twice on a path."""
    monkeypatch.setattr(trees, "MOST_CODES", most)
    tree = pd.DataFrame(
        {
            "feature": [0, 1, 0, -1, -1, -1, -1], "threshold": [5.0, 2.0, 8.0, 0, 0, 0, 0],
            "left": [1, 3, 5, -1, -1, -1, -1], "right": [2, 4, 6, -1, -1, -1, -1],
            "cover": [10.0, 6, 4, 2, 4, 1, 3], "value": [0, 0, 0, 1.0, 2.0, 7.0, -4.0],
        }
    )
    x = np.array([[1.0, 1.0], [6.0, 3.0], [9.0, 0.0], [5.0, 2.0]])

    def expected(row, known, node=0):
        if tree.left[node] < 0:
            return tree.value[node]
        l, r = tree.left[node], tree.right[node]
        if tree.feature[node] in known:
            return expected(row, known, l if row[tree.feature[node]] <= tree.threshold[node] else r)
        return sum(tree.cover[c] / tree.cover[node] * expected(row, known, c) for c in (l, r))

    phi, base = tree_shapley(tree, x)
    for i, row in enumerate(x):
        assert base + phi[i].sum() == pytest.approx(expected(row, {0, 1}))
        for f in (0, 1):
            others = [g for g in (0, 1) if g != f]
            want = sum(
                factorial(k) * factorial(1 - k) / factorial(2) * (expected(row, {*s, f}) - expected(row, set(s)))
                for k in range(2) for s in combinations(others, k)
            )
            assert phi[i, f] == pytest.approx(want)


def test_sample_is_repeatable(spark, prepared):
    def ids(df):
        return sorted(r.snapshot_id for r in prepare.sample_rows(df, 25).collect())

    assert ids(prepared) == ids(prepared.repartition(6)) and len(set(ids(prepared))) == 25
    digest = lambda s: hashlib.md5(f"{s}:42".encode()).hexdigest()
    every = sorted((r.snapshot_id for r in prepared.collect()), key=digest)
    for n in (0, 1, 25, 1199, 1200, 5000):
        assert sorted(r.snapshot_id for r in prepare.sample_rows(prepared, n).collect()) == sorted(every[:n])


# --- the training queries do the whole job


def test_queries_train_with_full_settings(data):
    for target in TARGETS:
        found = training.trained(data, target)
        assert (found.rf.getNumTrees, found.rf.getOrDefault("maxDepth"), found.rf.getOrDefault("minInstancesPerNode")) == (300, 15, 100)
        last = max(r.rounds for r in found.rounds.select("rounds").collect())
        assert found.gb.getOrDefault("maxDepth") == 6 and (last == 1000 or last - found.gb.getNumTrees >= 50)


def test_parts_are_trained_with_full_settings(data, monkeypatch):
    """Fits are replaced by the pooled models; only what is asked of them counts here."""
    pooled, asked = training.trained(data), []
    monkeypatch.setattr(models, "train_rf", lambda df, **p: asked.append({**models.RF_PARAMS, **p}) or pooled.rf)
    monkeypatch.setattr(models, "fit_gb", lambda df, weight=None, **p: asked.append({**models.GB_PARAMS, **p}) or pooled.gb)
    got = result("fit_per_partition", data)
    assert sorted({r.client for r in got.select("client").collect()}) == ["all", *(f"client_{k}" for k in range(1, 6))]
    forests, boosted = ([p for p in asked if key in p] for key in ("numTrees", "maxIter"))
    assert [(p["numTrees"], p["maxDepth"]) for p in forests] == [(60, 15)] * 10
    assert [(p["maxIter"], p["maxDepth"]) for p in boosted] == [(200, 6)] * 10


def test_importance_is_of_all_test_rows(data, monkeypatch):
    asked, of = [], explain.tree_attribution
    monkeypatch.setattr(explain, "tree_attribution", lambda *a, **p: asked.append(materialize(of(*a, **p), "asked")) or asked[-1])
    assert result("top_features", data).count() == 40
    rows = [training.trained(data, t).split("test").count() for t in TARGETS for _ in range(2)]
    assert min(rows) > 100 and [df.select("snapshot_id").distinct().count() for df in asked] == rows


def test_scored_table_uses_tuned_thresholds(data):
    got = materialize(result("scored_table", data), "scored-table")
    tuned = {(r.target, r.model): r.optimal_threshold for r in tuned_thresholds(training.scored(data)).collect()}
    rows = got.select("target", "model", "y_prob", "threshold", "y_pred_05", "y_pred_optimal").collect()
    assert len(tuned) == 4 and all(r.threshold == pytest.approx(tuned[r.target, r.model]) for r in rows)
    assert all(r.y_pred_optimal == (r.y_prob >= r.threshold) and r.y_pred_05 == (r.y_prob >= 0.5) for r in rows)
    assert any(r.y_pred_optimal != r.y_pred_05 for r in rows)
