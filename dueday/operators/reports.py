"""Report queries: small selections over the metric tables.

The columns each report picks, and their order, are fixed values of the output contract.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def report_rounding(df: DataFrame, digits: int = 4, columns: Sequence[str] | None = None) -> DataFrame:
    """Round floating-point columns half to even."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.bround(c, digits) for c in columns})


def sort_mixed(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.orderBy(*order)


def topk_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group; Spark cuts each task to k per group before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def rank_within_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rank the features of a model; groups hold one row per feature."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def worst_slices(slices: DataFrame, k: int = 10) -> DataFrame:
    return slices.orderBy("roc_auc", "target", "model", "slice_col", "slice_val").limit(k)


def largest_gaps(fairness: DataFrame, k: int = 15) -> DataFrame:
    rows = fairness.where(F.col("tpr_gap_vs_overall").isNotNull())
    return (
        rows.orderBy(F.desc(F.abs("tpr_gap_vs_overall")), "target", "model", "slice_col", "group")
        .limit(k)
        .select("target", "model", "slice_col", "group", "tpr_gap_vs_overall", "fpr_gap_vs_overall", "n")
    )


def best_model_per_target(metrics: DataFrame, split: str = "test") -> DataFrame:
    """Highest ROC-AUC per target; the first model name wins a tie."""
    best = F.min(F.struct((-F.col("roc_auc")).alias("neg"), F.col("model")))
    return (
        metrics.where((F.col("split") == split) & F.col("roc_auc").isNotNull())
        .groupBy("target")
        .agg(best.alias("best"))
        .select("target", F.col("best.model").alias("model"), (-F.col("best.neg")).alias("roc_auc"))
    )


def performance_summary(metrics: DataFrame, split: str = "test") -> DataFrame:
    picked = metrics.where(F.col("split") == split).select(
        "target", "model", "roc_auc", "pr_auc", "f1", "precision", "recall", "balanced_accuracy"
    )
    return report_rounding(picked.orderBy("target", "model"))


def federated_summary(comparison: DataFrame) -> DataFrame:
    picked = comparison.where(F.col("federation").isin("centralized", "federated")).select(
        "target", "model", "federation", "roc_auc", "f1", "precision", "recall"
    )
    return report_rounding(picked.orderBy("target", "model", "federation"))


def fairness_summary(fairness: DataFrame) -> DataFrame:
    return report_rounding(
        fairness.select(
            "target", "model", "slice_col", "group", "roc_auc", "f1", "tpr", "fpr",
            "disparate_impact_ratio", "tpr_gap_vs_overall",
        )
    )


def gender_fairness(fairness: DataFrame, groups: Sequence[str] = ("F", "M")) -> DataFrame:
    picked = fairness.where((F.col("slice_col") == "CODE_GENDER") & F.col("group").isin(*groups)).select(
        "target", "model", "group", "positive_pred_rate", "disparate_impact_ratio", "tpr", "fpr", "f1"
    )
    return report_rounding(picked.orderBy("target", "model", "group"))


def harm_by_income(harm: DataFrame, target: str = "missed_upcoming_emi", model: str = "rf") -> DataFrame:
    picked = harm.where(
        (F.col("slice_col") == "NAME_INCOME_TYPE") & (F.col("target") == target) & (F.col("model") == model)
    ).select("group", "n", "fp_rate_exclusion_harm", "fn_rate_institutional_harm")
    return report_rounding(picked.orderBy(F.desc("fp_rate_exclusion_harm"), "group"))


def gender_calibration(calibration: DataFrame) -> DataFrame:
    picked = calibration.where(F.col("slice_col") == "CODE_GENDER").select(
        "target", "model", "group", "prevalence", "mean_predicted_prob", "brier_score", "calibration_gap"
    )
    return report_rounding(picked.orderBy("target", "model", "group"), 5)


def top_features(attribution: DataFrame, k: int = 10) -> DataFrame:
    order = [F.desc("mean_abs_shap"), F.asc("feature")]
    picked = topk_per_group(attribution.drop("rank"), ["target", "model"], order, k)
    return report_rounding(picked.select("target", "model", "rank", "feature", "mean_abs_shap"), 5)


def local_best_worst(comparison: DataFrame) -> DataFrame:
    return (
        comparison.where(F.col("federation") == "local")
        .groupBy("target", "model")
        .agg(F.max("roc_auc").alias("best_roc_auc"), F.min("roc_auc").alias("worst_roc_auc"))
    )


def federation_gap(comparison: DataFrame) -> DataFrame:
    """Pooled, averaged and per-part ROC-AUC side by side, by conditional aggregation."""

    def of(kind: str) -> Column:
        return F.when(F.col("federation") == kind, F.col("roc_auc"))

    return (
        comparison.groupBy("target", "model")
        .agg(
            F.max(of("centralized")).alias("centralized_roc_auc"),
            F.max(of("federated")).alias("federated_roc_auc"),
            F.max(of("local")).alias("local_best_roc_auc"),
            F.min(of("local")).alias("local_worst_roc_auc"),
        )
        .withColumn("gap", F.col("federated_roc_auc") - F.col("centralized_roc_auc"))
    )
