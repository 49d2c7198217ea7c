"""Classification, calibration, fairness and harm tables over a scored table.

A scored table has one row per (target, model, snapshot) with ``label``,
``y_prob``, the slice columns and the two predictions. Counts for all slices
come from one cube: rows are combined by all slice columns at once (a product
of small category sets) and only that small result is fanned out to slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import FAIRNESS_COLS, SLICE_COLS
from .assemble import threshold_lookup
from .curves import (
    average_precision_of,
    best_f1_of,
    pr_curve,
    roc_auc_of,
    score_counts,
    split_points,
    with_part,
)

MODEL_KEYS = ["target", "model"]

# Fixed values.
FIXED_THRESHOLDS = (0.3, 0.4, 0.5, 0.6)
MIN_GROUP_ROWS = 500


def scored_table(scored: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Keep the columns diagnosis needs and add both predictions."""
    keep = [c for c in (*MODEL_KEYS, "SK_ID_CURR", "snapshot_day", "label", *SLICE_COLS, "y_prob") if c in scored.columns]
    rows = scored.select(*keep)
    if thresholds is None:
        rows = rows.withColumn("threshold", F.lit(0.5))
    else:
        rows = threshold_lookup(rows, thresholds)
    return rows.withColumns(
        {
            "y_pred_05": S.apply_threshold("y_prob", F.lit(0.5)),
            "y_pred_optimal": S.apply_threshold("y_prob", F.col("threshold")),
        }
    )


# --- counts at a threshold -------------------------------------------------


def counts_at(label: str, pred: Column) -> dict[str, Column]:
    y = F.col(label)
    return {
        "TP": F.count_if((pred == 1) & (y == 1)),
        "FP": F.count_if((pred == 1) & (y == 0)),
        "FN": F.count_if((pred == 0) & (y == 1)),
        "TN": F.count_if((pred == 0) & (y == 0)),
    }


def confusion_matrix(
    df: DataFrame, by: Sequence[str], threshold: float = 0.5, score: str = "y_prob", label: str = "label"
) -> DataFrame:
    pred = S.apply_threshold(score, F.lit(threshold))
    cells = counts_at(label, pred)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()]).withColumn("threshold", F.lit(threshold))


def zero_ratio(top: Column, bottom: Column) -> Column:
    """A ratio that is 0 when undefined."""
    return F.coalesce(S.safe_ratio(top, bottom), F.lit(0.0))


def precision_of() -> Column:
    return zero_ratio(F.col("TP"), F.col("TP") + F.col("FP"))


def recall_of() -> Column:
    return zero_ratio(F.col("TP"), F.col("TP") + F.col("FN"))


def f1_of() -> Column:
    return zero_ratio(2 * F.col("TP"), 2 * F.col("TP") + F.col("FP") + F.col("FN"))


def balanced_accuracy_of() -> Column:
    """Mean recall over the classes that occur."""
    tpr = S.safe_ratio(F.col("TP"), F.col("TP") + F.col("FN"))
    tnr = S.safe_ratio(F.col("TN"), F.col("TN") + F.col("FP"))
    return F.when(tpr.isNull(), tnr).when(tnr.isNull(), tpr).otherwise((tpr + tnr) / F.lit(2.0))


def class_balance(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    return (
        df.groupBy(*by)
        .agg(
            F.count_if(F.col(label) == 0).alias("negatives"),
            F.count_if(F.col(label) == 1).alias("positives"),
        )
        .withColumn("pos_weight", S.safe_ratio("negatives", "positives"))
    )


def class_weights(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Balanced weights n / (2 n_class) and the positive weight neg / pos."""
    total = F.col("negatives") + F.col("positives")
    return class_balance(df, by, label).withColumns(
        {
            "weight_negative": S.safe_ratio(total, 2 * F.col("negatives")),
            "weight_positive": S.safe_ratio(total, 2 * F.col("positives")),
        }
    )


def brier_score(df: DataFrame, by: Sequence[str], score: str = "y_prob", label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"))


# --- whole-group metrics ---------------------------------------------------


def classification_metrics(
    df: DataFrame, by: Sequence[str], threshold: Column | float = 0.5, score: str = "y_prob", label: str = "label"
) -> DataFrame:
    """Ranking and threshold metrics per group from one curve.

    ``threshold`` may be a number or a column that is constant in each group
    and listed in ``by``. The curve already holds the counts at every score, so
    the scored rows are read once.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    curve = pr_curve(df, by, score, label)
    above = F.col("score") >= limit
    cells = curve.groupBy(*by).agg(
        (F.max("positives") + F.max("negatives")).alias("n_samples"),
        roc_auc_of().alias("roc_auc"),
        average_precision_of().alias("pr_auc"),
        F.coalesce(F.sum(F.when(above, F.col("tp"))), F.lit(0)).alias("TP"),
        F.coalesce(F.sum(F.when(above, F.col("fp"))), F.lit(0)).alias("FP"),
        F.coalesce(F.sum(F.when(~above, F.col("tp"))), F.lit(0)).alias("FN"),
        F.coalesce(F.sum(F.when(~above, F.col("fp"))), F.lit(0)).alias("TN"),
    )
    return cells.select(
        *by,
        "n_samples",
        S.safe_ratio(F.col("TP") + F.col("FN"), F.col("n_samples")).alias("positive_rate"),
        "roc_auc",
        "pr_auc",
        f1_of().alias("f1"),
        precision_of().alias("precision"),
        recall_of().alias("recall"),
        balanced_accuracy_of().alias("balanced_accuracy"),
    )


def fixed_threshold_metrics(
    df: DataFrame,
    by: Sequence[str],
    thresholds: Sequence[float] = FIXED_THRESHOLDS,
    score: str = "y_prob",
    label: str = "label",
) -> DataFrame:
    """F1, precision and recall at fixed thresholds and at the best-F1 score.

    Works on the curve (one row per distinct score), where a threshold's counts
    are a conditional sum, so rows are not multiplied by the thresholds.
    """
    curve = pr_curve(df, by, score, label)
    best = best_f1_of(curve, by).select(*by, F.col("optimal_threshold"))
    tagged = curve.join(F.broadcast(best), list(by))  # one row per group
    limits = [(F.lit(float(t)), "fixed") for t in thresholds] + [(F.col("optimal_threshold"), "optimal_f1")]

    def cells(limit: Column) -> list[Column]:
        above = F.col("score") >= limit
        return [
            F.coalesce(F.sum(F.when(above, F.col("tp"))), F.lit(0)).alias("TP"),
            F.coalesce(F.sum(F.when(above, F.col("fp"))), F.lit(0)).alias("FP"),
            F.coalesce(F.sum(F.when(~above, F.col("tp"))), F.lit(0)).alias("FN"),
        ]

    wide = tagged.groupBy(*by, "optimal_threshold").agg(
        *[F.struct(limit.alias("threshold"), F.lit(kind).alias("threshold_type"), *cells(limit)).alias(f"t{i}")
          for i, (limit, kind) in enumerate(limits)]
    )
    return wide.select(*by, F.inline(F.array(*[f"t{i}" for i in range(len(limits))]))).select(
        *by,
        "threshold",
        "threshold_type",
        f1_of().alias("f1"),
        precision_of().alias("precision"),
        recall_of().alias("recall"),
    )


# --- slices ----------------------------------------------------------------


def _fan_out(df: DataFrame, slices: Sequence[str], with_overall: bool = False) -> DataFrame:
    """One row per slice column with a value; missing values belong to no slice."""
    pairs = [F.struct(F.lit(c).alias("slice_col"), F.col(c).alias("slice_val")) for c in slices]
    if with_overall:
        pairs.append(F.struct(F.lit("overall").alias("slice_col"), F.lit("all").alias("slice_val")))
    return (
        df.withColumn("slice", F.explode(F.array(*pairs)))
        .where("slice.slice_val IS NOT NULL")
        .select("*", "slice.slice_col", "slice.slice_val")
        .drop("slice", *slices)
    )


def slice_counts(
    scored: DataFrame, slices: Sequence[str], with_overall: bool = False, pred: str = "y_pred_optimal"
) -> DataFrame:
    """Additive counts and sums per (target, model, slice value)."""
    y, p = F.col("label"), F.col("y_prob")
    base = {
        **counts_at("label", F.col(pred)),
        "n": F.count(F.lit(1)),
        "sum_prob": F.sum(p),
        "sum_sq": F.sum(F.pow(p - y, F.lit(2.0))),
    }
    cube = scored.groupBy(*MODEL_KEYS, *slices).agg(*[c.alias(n) for n, c in base.items()])
    return (
        _fan_out(cube, slices, with_overall)
        .groupBy(*MODEL_KEYS, "slice_col", "slice_val")
        .agg(*[F.sum(n).alias(n) for n in base])
        .withColumns({"pos": F.col("TP") + F.col("FN"), "pred_pos": F.col("TP") + F.col("FP")})
    )


def slice_table(scored: DataFrame, slices: Sequence[str], pred: str = "y_pred_optimal") -> DataFrame:
    """Counts, sums, ROC-AUC and average precision per (target, model, slice value), and overall without the areas.

    One scan: rows are combined by (slice columns, score) and laid out once, by (target, model) and part of the score. The
    windows of all slice columns run inside that layout. What the higher parts hold of a slice value enters
    as a row above all scores of the part, with the other slice columns missing, so nothing is joined. Only
    sums per combination of slice values are fanned out to the slices.
    """
    parted = with_part(scored, split_points(scored))
    counts = score_counts(parted, [*MODEL_KEYS, *slices, "part", F.col(pred).alias("pred")])
    keys = [*MODEL_KEYS, "slice_col", "slice_val"]
    small = counts.groupBy(*MODEL_KEYS, *slices, "part").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    by_part = _fan_out(small, slices).groupBy(*keys, "part").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    higher = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    above = by_part.withColumns({c: F.sum(c).over(higher) for c in ("tp", "fp")}).where("tp IS NOT NULL")
    above = above.select(
        *MODEL_KEYS, *[F.when(F.col("slice_col") == c, F.col("slice_val")).alias(c) for c in slices],
        "part", F.lit(None).cast("int").alias("pred"), F.lit(None).cast("double").alias("score"), "tp", "fp", F.lit(True).alias("carried"),
    )
    rows = counts.select(*MODEL_KEYS, *slices, "part", F.col("pred").cast("int").alias("pred"), F.col("score").cast("double").alias("score"), "tp", "fp", F.lit(False).alias("carried"))
    down = F.when(F.col("carried"), F.lit(float("-inf"))).otherwise(F.coalesce(-F.col("score"), F.lit(float("inf"))))
    laid = rows.union(above).repartition(*MODEL_KEYS, "part").withColumn("down", down)

    for c in slices:
        down_the_slice = Window.partitionBy(*MODEL_KEYS, "part", c).orderBy("down")
        # equal scores are peers: they share their totals, and all but the first follow themselves
        laid = laid.withColumns({f"{c}_{k}": F.sum(k).over(down_the_slice) for k in ("tp", "fp")})
        laid = laid.withColumns({f"{c}_{k}_last": F.coalesce(F.lag(f"{c}_{k}").over(down_the_slice), F.lit(0)) for k in ("tp", "fp")})

    def area(c: str) -> Column:
        return (F.col(f"{c}_fp") - F.col(f"{c}_fp_last")) * (F.col(f"{c}_tp") + F.col(f"{c}_tp_last")) / F.lit(2.0)

    def steps(c: str) -> Column:
        return (F.col(f"{c}_tp") - F.col(f"{c}_tp_last")) * (F.col(f"{c}_tp") / (F.col(f"{c}_tp") + F.col(f"{c}_fp")))

    def total(column: str, pred: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("pred") == pred, F.col(column))), F.lit(0))

    p, rows_at = F.col("score"), F.col("tp") + F.col("fp")
    sums = {
        "TP": total("tp", 1), "FP": total("fp", 1), "FN": total("tp", 0), "TN": total("fp", 0),
        "n": F.sum(rows_at), "pos": F.sum("tp"), "sum_prob": F.sum(p * rows_at),
        "sum_sq": F.sum(F.col("tp") * F.pow(p - 1, F.lit(2.0)) + F.col("fp") * F.pow(p, F.lit(2.0))),
    }
    areas = {f"{kind}_{c}": F.sum(of(c)) for c in slices for kind, of in (("area", area), ("steps", steps))}
    # a row per combination of slice values from here on
    cells = laid.where("NOT carried").groupBy(*MODEL_KEYS, *slices).agg(*[c.alias(n) for n, c in {**sums, **areas}.items()])
    nothing = F.lit(None).cast("double")
    told = [(c, F.col(c), F.col(f"area_{c}"), F.col(f"steps_{c}")) for c in slices] + [("overall", F.lit("all"), nothing, nothing)]
    each = [F.struct(F.lit(n).alias("slice_col"), v.alias("slice_val"), a.alias("area"), s.alias("steps")) for n, v, a, s in told]
    fanned = cells.select(*MODEL_KEYS, *sums, F.inline(F.array(*each))).where("slice_val IS NOT NULL")
    summed = fanned.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in (*sums, "area", "steps")])
    # as doubles: the product of two row counts can exceed a bigint
    pairs = F.col("pos").cast("double") * (F.col("n") - F.col("pos")).cast("double")
    return summed.withColumns(
        {
            "pred_pos": F.col("TP") + F.col("FP"),
            "roc_auc": F.col("area") / F.nullif(pairs, F.lit(0.0)),
            "pr_auc": F.col("steps") / F.nullif(F.col("pos"), F.lit(0)),
        }
    ).drop("area", "steps")


def min_group_filter(
    groups: DataFrame, min_rows: int, min_positives: int = 1, both_classes: bool = True
) -> DataFrame:
    """Drop groups that are too small to judge, or that hold one class only."""
    keep = (F.col("n") >= min_rows) & (F.col("pos") >= min_positives)
    if both_classes:
        keep = keep & (F.col("pos") < F.col("n"))
    return groups.where(keep)


def fp_fn_by_slice(scored: DataFrame, slices: Sequence[str] = SLICE_COLS, min_rows: int = 50) -> DataFrame:
    """Confusion, precision, recall, F1 and error rates, overall and per slice value."""
    groups = slice_counts(scored, slices, with_overall=True)
    overall = F.col("slice_col") == "overall"
    kept = groups.where(overall | ((F.col("n") >= min_rows) & (F.col("pos") > 0) & (F.col("pos") < F.col("n"))))
    return kept.select(
        *MODEL_KEYS,
        "slice_col",
        "slice_val",
        "n",
        F.col("pos").alias("actual_positive"),
        F.col("pred_pos").alias("predicted_positive"),
        "TP",
        "FP",
        "FN",
        "TN",
        precision_of().alias("precision"),
        recall_of().alias("recall"),
        f1_of().alias("f1"),
        (F.col("FP") / F.greatest(F.col("TN") + F.col("FP"), F.lit(1))).alias("fpr"),
        (F.col("FN") / F.greatest(F.col("TP") + F.col("FN"), F.lit(1))).alias("fnr"),
    )


def slice_performance(
    scored: DataFrame, slices: Sequence[str] = SLICE_COLS, min_rows: int = 100, min_positives: int = 10
) -> DataFrame:
    groups = slice_table(scored, slices).where("slice_col <> 'overall'")
    return min_group_filter(groups, min_rows, min_positives).select(
        *MODEL_KEYS,
        "slice_col",
        "slice_val",
        "n",
        S.safe_ratio("pos", "n").alias("positive_rate"),
        "roc_auc",
        "pr_auc",
        (F.col("sum_sq") / F.col("n")).alias("brier"),
    )


def calibration_curve(
    df: DataFrame, by: Sequence[str] = MODEL_KEYS, bins: int = 10, score: str = "y_prob", label: str = "label"
) -> DataFrame:
    """Mean prediction and observed rate in equal-width bins, right-closed.

    ``bin`` counts the non-empty bins, ``true_bin`` is the position on [0, 1].
    """
    p, y = F.col(score), F.col(label)
    # a score on an inner edge belongs to the bin below it
    true_bin = sum((F.when(p > F.lit(k / bins), 1).otherwise(0) for k in range(1, bins)), F.lit(0))
    cells = df.groupBy(*by, true_bin.alias("true_bin")).agg(
        F.count(F.lit(1)).alias("bin_rows"),
        F.avg(p).alias("mean_predicted_prob"),
        F.avg(y).alias("actual_positive_rate"),
        F.sum(F.pow(p - y, F.lit(2.0))).alias("sum_sq"),
    )
    # at most ``bins`` rows per group from here on
    group = Window.partitionBy(*by)
    return cells.select(
        *by,
        (F.row_number().over(group.orderBy("true_bin")) - 1).alias("bin"),
        "true_bin",
        "mean_predicted_prob",
        "actual_positive_rate",
        F.abs(F.col("actual_positive_rate") - F.col("mean_predicted_prob")).alias("calibration_error"),
        (F.sum("sum_sq").over(group) / F.sum("bin_rows").over(group)).alias("brier_score"),
    )


def _group_columns(areas: bool) -> dict[str, Column]:
    """Group metrics that are NULL, not 0, when undefined; F1 alone is 0."""
    pos, neg, pred = F.col("pos"), F.col("n") - F.col("pos"), F.col("pred_pos")
    tpr = S.safe_ratio(F.col("TP"), pos)
    return {
        "n": F.col("n"),
        "n_actual_pos": pos,
        "n_predicted_pos": pred,
        "positive_pred_rate": S.safe_ratio(pred, F.col("n")),
        **({"roc_auc": F.col("roc_auc"), "pr_auc": F.col("pr_auc")} if areas else {}),
        "f1": f1_of(),
        "precision": S.safe_ratio(F.col("TP"), pred),
        "recall": tpr,
        "tpr": tpr,
        "fpr": S.safe_ratio(F.col("FP"), neg),
        "fnr": S.safe_ratio(F.col("FN"), pos),
        "brier": F.when(pos > 0, F.col("sum_sq") / F.col("n")),
    }


def _grouped(scored: DataFrame, slices: Sequence[str], areas: bool) -> DataFrame:
    """Group metrics of every slice value and of all rows (slice_col ``overall``)."""
    groups = slice_table(scored, slices) if areas else slice_counts(scored, slices, with_overall=True)
    named = [c.alias(n) for n, c in _group_columns(areas).items()]
    return groups.select(*MODEL_KEYS, "slice_col", F.col("slice_val").alias("group"), *named)


def group_metrics(
    scored: DataFrame, slices: Sequence[str] = FAIRNESS_COLS, min_rows: int = MIN_GROUP_ROWS, areas: bool = True
) -> DataFrame:
    """Metrics per slice value; without ``areas`` no curve is built."""
    return _grouped(scored, slices, areas).where((F.col("slice_col") != "overall") & (F.col("n") >= min_rows))


def fairness_metrics(
    scored: DataFrame, slices: Sequence[str] = FAIRNESS_COLS, min_rows: int = MIN_GROUP_ROWS, areas: bool = True
) -> DataFrame:
    """Group metrics with disparate impact and gaps against the whole population; without ``areas`` no curve is built."""
    # a few rows per (target, model) from here on
    model = Window.partitionBy(*MODEL_KEYS)
    base = {c: F.max(F.when(F.col("slice_col") == "overall", F.col(c))).over(model) for c in ("positive_pred_rate", "tpr", "fpr")}
    rows = _grouped(scored, slices, areas).withColumns({f"base_{c}": column for c, column in base.items()})
    return (
        rows.where((F.col("slice_col") != "overall") & (F.col("n") >= min_rows))
        .withColumns(
            {
                "disparate_impact_ratio": S.safe_ratio("positive_pred_rate", "base_positive_pred_rate"),
                "tpr_gap_vs_overall": F.col("tpr") - F.col("base_tpr"),
                "fpr_gap_vs_overall": F.col("fpr") - F.col("base_fpr"),
            }
        )
        .drop(*[f"base_{c}" for c in base])
    )


def harm_analysis(scored: DataFrame, slices: Sequence[str] = FAIRNESS_COLS, min_rows: int = MIN_GROUP_ROWS) -> DataFrame:
    """False positives among good payers, false negatives among bad ones, per group."""
    groups = slice_counts(scored, slices).where(F.col("n") >= min_rows)
    neg = F.col("n") - F.col("pos")
    return groups.select(
        *MODEL_KEYS,
        "slice_col",
        F.col("slice_val").alias("group"),
        "n",
        neg.alias("n_actual_neg"),
        F.col("pos").alias("n_actual_pos"),
        F.col("FP").alias("fp"),
        F.col("FN").alias("fn"),
        S.safe_ratio(F.col("FP"), neg).alias("fp_rate_exclusion_harm"),
        S.safe_ratio(F.col("FN"), F.col("pos")).alias("fn_rate_institutional_harm"),
    )


def calibration_fairness(
    scored: DataFrame, slices: Sequence[str] = FAIRNESS_COLS, min_rows: int = MIN_GROUP_ROWS
) -> DataFrame:
    groups = min_group_filter(slice_counts(scored, slices), min_rows, both_classes=False)
    prevalence, mean_prob = F.col("pos") / F.col("n"), F.col("sum_prob") / F.col("n")
    return groups.select(
        *MODEL_KEYS,
        "slice_col",
        F.col("slice_val").alias("group"),
        "n",
        prevalence.alias("prevalence"),
        mean_prob.alias("mean_predicted_prob"),
        (F.col("sum_sq") / F.col("n")).alias("brier_score"),
        (mean_prob - prevalence).alias("calibration_gap"),
    )
