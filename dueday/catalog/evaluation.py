"""Curves, classification metrics, slices, calibration, fairness and reports.

Scores come from a fixed formula over the snapshots, so both engines see the
same ties.
"""

from pyspark.sql import functions as F

from ..operators import curves, metrics, models, reports, splits
from ..operators.assemble import threshold_lookup
from ..operators.metrics import MODEL_KEYS
from ..schemas import SLICE_COLS
from .base import query

BY = ["target", "model", "split"]


def scored(d):
    return splits.join_split_map(d("fx_pred"), d.split_map)


def federated(d):
    """Long scores of a pooled model, three parts and their mean."""
    k = F.when(F.col("model") == "rf", 13).otherwise(23)

    def part(i):
        return ((F.col("SK_ID_CURR") * (k + i) + F.col("ord") * 7) % 53 + 30 * F.col("label")) / F.lit(100.0)

    rows = d("fx_pred").withColumns({f"s{i}": part(i) for i in (1, 2, 3)})

    def row(kind, client, prob):
        return F.struct(F.lit(kind).alias("federation"), F.lit(client).alias("client"), prob.alias("score"))

    mean = (F.col("s1") + F.col("s2") + F.col("s3")) / F.lit(3.0)
    variants = [row("centralized", "all", F.col("y_prob")), row("federated", "all", mean)]
    variants += [row("local", f"client_{i}", F.col(f"s{i}")) for i in (1, 2, 3)]
    return rows.select("target", "model", "label", F.inline(F.array(*variants))).withColumnRenamed("score", "y_prob")


def comparison(d):
    return models.federated_comparison(threshold_lookup(federated(d), d("fx_threshold")))


def metric_table(d):
    return metrics.classification_metrics(scored(d), BY)


@query("roc_auc", "SELECT target, model, split, roc_auc FROM ov_areas", roc_auc=6)
def roc_auc(d):
    return curves.roc_auc(scored(d), BY)


@query("average_precision", "SELECT target, model, split, pr_auc FROM ov_areas", pr_auc=6)
def average_precision(d):
    return curves.average_precision(scored(d), BY)


@query("pr_curve", 'SELECT target, model, split, score, cum_tp, cum_fp, "precision", recall FROM ov_curve', precision=6, recall=6)
def pr_curve(d):
    return curves.pr_curve(scored(d), BY).select(*BY, "score", "cum_tp", "cum_fp", "precision", "recall")


@query("best_f1_threshold", "SELECT * FROM ov_best", best_f1=6)
def best_f1_threshold(d):
    return curves.best_f1_threshold(scored(d), BY)


@query(
    "confusion_matrix",
    """SELECT target, model, split, count(*) FILTER (y_pred_05 = 1 AND label = 1) AS TP, count(*) FILTER (y_pred_05 = 1 AND label = 0) AS FP,
    count(*) FILTER (y_pred_05 = 0 AND label = 1) AS FN, count(*) FILTER (y_pred_05 = 0 AND label = 0) AS TN, 0.5E0 AS threshold FROM ov_pred GROUP BY 1, 2, 3""",
)
def confusion_matrix(d):
    return metrics.confusion_matrix(scored(d), BY)


METRIC_DIGITS = {c: 6 for c in ("roc_auc", "pr_auc", "f1", "precision", "recall", "balanced_accuracy")}


@query("classification_metrics", "SELECT * FROM ov_metrics", positive_rate=6, **METRIC_DIGITS)
def classification_metrics(d):
    return metric_table(d)


@query(
    "fixed_threshold_metrics",
    """SELECT target, model, split, threshold, threshold_type, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall
    FROM (SELECT p.target, p.model, p.split, t.threshold, t.threshold_type, count(*) FILTER (y_prob >= t.threshold AND label = 1) AS tp, count(*) FILTER (y_prob >= t.threshold AND label = 0) AS fp,
      count(*) FILTER (y_prob < t.threshold AND label = 1) AS fn
     FROM ov_pred p JOIN (SELECT target, model, split, unnest([0.3E0, 0.4E0, 0.5E0, 0.6E0, optimal_threshold]) AS threshold, unnest(['fixed', 'fixed', 'fixed', 'fixed', 'optimal_f1']) AS threshold_type FROM ov_best) t
      ON p.target = t.target AND p.model = t.model AND p.split = t.split GROUP BY 1, 2, 3, 4, 5) c""",
    f1=6, precision=6, recall=6,
)
def fixed_threshold_metrics(d):
    return metrics.fixed_threshold_metrics(scored(d), BY)


@query(
    "fp_fn_by_slice",
    """SELECT target, model, slice_col, slice_val, n, pos AS actual_positive, pred_pos AS predicted_positive, tp AS TP, fp AS FP, fn AS FN, tn AS TN,
    coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
    fp / greatest(tn + fp, 1) AS fpr, fn / greatest(tp + fn, 1) AS fnr FROM (
     SELECT target, model, slice_col, slice_val, n, pos, pred_pos, tp, fp, fn, tn FROM ov_cells WHERE n >= 50 AND pos > 0 AND pos < n
     UNION ALL SELECT target, model, 'overall', 'all', n, pos, pred_pos, tp, fp, fn, tn FROM ov_all) c""",
    precision=6, recall=6, f1=6, fpr=6, fnr=6,
)
def fp_fn_by_slice(d):
    return metrics.fp_fn_by_slice(d("fx_pred"))


SLICE_DIGITS = {"positive_rate": 6, "roc_auc": 6, "pr_auc": 6, "brier": 6}


@query("slice_performance", "SELECT * FROM ov_slices", **SLICE_DIGITS)
def slice_performance(d):
    return metrics.slice_performance(d("fx_pred"))


@query("brier_score", "SELECT model, avg((y_prob - label) * (y_prob - label)) AS brier FROM fx_pred GROUP BY 1", brier=6)
def brier_score(d):
    return metrics.brier_score(d("fx_pred"), ["model"])


@query(
    "calibration_curve",
    """SELECT target, model, CAST(row_number() OVER (PARTITION BY target, model ORDER BY b) - 1 AS INT) AS bin, b AS true_bin, mp AS mean_predicted_prob, fop AS actual_positive_rate,
    abs(fop - mp) AS calibration_error, sum(sq) OVER (PARTITION BY target, model) / sum(n) OVER (PARTITION BY target, model) AS brier_score
    FROM (SELECT target, model, CAST(b AS INT) AS b, count(*) AS n, avg(y_prob) AS mp, avg(label) AS fop, sum((y_prob - label) * (y_prob - label)) AS sq FROM (
      SELECT *, (SELECT count(*) FROM (SELECT unnest([0.1E0, 0.2E0, 0.3E0, 0.4E0, 0.5E0, 0.6E0, 0.7E0, 0.8E0, 0.9E0]) AS edge) e WHERE p.y_prob > edge) AS b FROM fx_pred p) q GROUP BY 1, 2, 3) c""",
    mean_predicted_prob=6, actual_positive_rate=6, calibration_error=6, brier_score=6,
)
def calibration_curve(d):
    return metrics.calibration_curve(d("fx_pred"))


GROUP_DIGITS = {c: 6 for c in ("positive_pred_rate", "roc_auc", "pr_auc", "f1", "precision", "recall", "tpr", "fpr", "fnr", "brier")}


@query("group_metrics", "SELECT * FROM ov_groups", **GROUP_DIGITS)
def group_metrics(d):
    return metrics.group_metrics(d("fx_pred"))


def fairness(d, areas=True):
    return metrics.fairness_metrics(d("fx_pred"), areas=areas)


@query("fairness_metrics", "SELECT * FROM ov_fairness", disparate_impact_ratio=6, tpr_gap_vs_overall=6, fpr_gap_vs_overall=6, **GROUP_DIGITS)
def fairness_metrics(d):
    return fairness(d)


@query("harm_analysis", "SELECT * FROM ov_harm", fp_rate_exclusion_harm=6, fn_rate_institutional_harm=6)
def harm_analysis(d):
    return metrics.harm_analysis(d("fx_pred"))


@query("calibration_fairness", "SELECT * FROM ov_calfair", prevalence=6, mean_predicted_prob=6, brier_score=6, calibration_gap=6)
def calibration_fairness(d):
    return metrics.calibration_fairness(d("fx_pred"))


@query("ensemble_average", "SELECT SK_ID_CURR, ord, avg(y_prob) AS y_prob FROM fx_pred GROUP BY 1, 2", y_prob=6)
def ensemble_average(d):
    return models.ensemble_average(d("fx_pred"), ["SK_ID_CURR", "ord"])


COMPARE_DIGITS = {"positive_rate": 6, **METRIC_DIGITS}


@query("federated_comparison", "SELECT * FROM ov_comparison", **COMPARE_DIGITS)
def federated_comparison(d):
    return comparison(d)


@query(
    "local_best_worst",
    "SELECT target, model, max(roc_auc) AS best_roc_auc, min(roc_auc) AS worst_roc_auc FROM ov_comparison WHERE federation = 'local' GROUP BY 1, 2",
    best_roc_auc=6, worst_roc_auc=6,
)
def local_best_worst(d):
    return reports.local_best_worst(comparison(d))


@query(
    "stratified_partition",
    """SELECT label, part, n // 5 + CAST(part < n % 5 AS BIGINT) AS part_rows FROM (SELECT label, count(*) AS n, unnest([0, 1, 2, 3, 4]) AS part
    FROM fx_snap_labelled GROUP BY 1) x""".replace("fx_snap_labelled", "(SELECT missed_upcoming_emi AS label FROM ov_missed) s"),
)
def stratified_partition(d):
    parts = models.stratified_partition(d.missed_rows)
    return parts.groupBy("label", "part").agg(F.countDistinct("snapshot_id").alias("part_rows"))


@query("rank_within_group", "SELECT *, CAST(row_number() OVER (PARTITION BY target, model ORDER BY round(brier, 9), slice_col, slice_val) AS INT) AS rank FROM ov_slices", **SLICE_DIGITS)
def rank_within_group(d):
    order = [F.round("brier", 9).asc(), F.asc("slice_col"), F.asc("slice_val")]
    return reports.rank_within_group(metrics.slice_performance(d("fx_pred")), MODEL_KEYS, order)


@query("worst_slices", "SELECT * FROM ov_slices ORDER BY round(roc_auc, 9), target, model, slice_col, slice_val LIMIT 10", **SLICE_DIGITS)
def worst_slices(d):
    return reports.worst_slices(metrics.slice_performance(d("fx_pred"), SLICE_COLS))


@query(
    "largest_gaps",
    """SELECT target, model, slice_col, "group", tpr_gap_vs_overall, fpr_gap_vs_overall, n FROM ov_fairness WHERE tpr_gap_vs_overall IS NOT NULL
    ORDER BY abs(tpr_gap_vs_overall) DESC, target, model, slice_col, "group" LIMIT 15""",
    tpr_gap_vs_overall=6, fpr_gap_vs_overall=6,
)
def largest_gaps(d):
    return reports.largest_gaps(fairness(d, areas=False))


@query(
    "best_model_per_target",
    "SELECT target, arg_max(model, roc_auc) AS model, max(roc_auc) AS roc_auc FROM ov_metrics WHERE split = 'test' GROUP BY 1",
    roc_auc=6,
)
def best_model_per_target(d):
    return reports.best_model_per_target(metric_table(d))


def _even(cols, digits):
    return ", ".join(f"round_even({c}, {digits}) AS {c}" for c in cols)


PERF = ["roc_auc", "pr_auc", "f1", '"precision"', "recall", "balanced_accuracy"]


@query("performance_summary", f"SELECT target, model, {_even(PERF, 4)} FROM ov_metrics WHERE split = 'test'", **METRIC_DIGITS)
def performance_summary(d):
    return reports.performance_summary(metric_table(d))


FED = ["roc_auc", "f1", '"precision"', "recall"]


@query(
    "federated_summary",
    f"SELECT target, model, federation, {_even(FED, 4)} FROM ov_comparison WHERE federation IN ('centralized', 'federated')",
    roc_auc=6, f1=6, precision=6, recall=6,
)
def federated_summary(d):
    return reports.federated_summary(comparison(d))


FAIR = ["roc_auc", "f1", "tpr", "fpr", "disparate_impact_ratio", "tpr_gap_vs_overall"]


@query("fairness_summary", f'SELECT target, model, slice_col, "group", {_even(FAIR, 4)} FROM ov_fairness', **{c: 4 for c in FAIR})
def fairness_summary(d):
    return reports.fairness_summary(fairness(d))


GENDER = ["positive_pred_rate", "disparate_impact_ratio", "tpr", "fpr", "f1"]


@query(
    "gender_fairness",
    f"""SELECT target, model, "group", {_even(GENDER, 4)} FROM ov_fairness WHERE slice_col = 'CODE_GENDER' AND "group" IN ('F', 'M')""",
    **{c: 4 for c in GENDER},
)
def gender_fairness(d):
    return reports.gender_fairness(fairness(d, areas=False))


@query(
    "harm_by_income",
    f"""SELECT "group", n, {_even(["fp_rate_exclusion_harm", "fn_rate_institutional_harm"], 4)} FROM ov_harm
    WHERE slice_col = 'NAME_INCOME_TYPE' AND model = 'rf' AND target = 'missed_upcoming_emi'""",
    fp_rate_exclusion_harm=4, fn_rate_institutional_harm=4,
)
def harm_by_income(d):
    return reports.harm_by_income(metrics.harm_analysis(d("fx_pred")))


CAL = ["prevalence", "mean_predicted_prob", "brier_score", "calibration_gap"]


@query(
    "gender_calibration",
    f"""SELECT target, model, "group", {_even(CAL, 5)} FROM ov_calfair WHERE slice_col = 'CODE_GENDER'""",
    **{c: 5 for c in CAL},
)
def gender_calibration(d):
    return reports.gender_calibration(metrics.calibration_fairness(d("fx_pred")))
