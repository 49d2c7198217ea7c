"""Exact ranking curves: ROC-AUC, average precision, PR points, best F1.

Rows are first reduced to one per (group, distinct score), which removes any
pile-up on one score. A quantile sketch of the scores plans their parts: the part is an expression
of the score, so a distinct score always falls into the same part and nothing has to be written. Running totals
are windows inside a part plus what the higher parts hold, a small table; no group has to fit in
one task. Only the sketch runs before the result is read. Values that are no numbers are laid out by
Spark's range partitioning instead, which is written once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import materialize


PARTS_A_TASK = 4  # several small parts of each group even out what a task of a shuffle gets


def split_points(df: DataFrame, score: str = "y_prob", parts: int | None = None) -> list[float]:
    """Scores that cut ``df`` into even parts, a few for each task of a shuffle; one scan of one column."""
    parts = parts or PARTS_A_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return []
    ends = [k / parts for k in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(score).cast("double"), ends, max(10_000, 10 * parts)).alias("points")).first()
    return sorted({x for x in row.points or [] if x == x})


def with_part(df: DataFrame, points: Sequence[float], score: str = "y_prob") -> DataFrame:
    """Add ``part``: how many of the points are not above the score; a missing score has a part of its own."""
    if not points:
        return df.withColumn("part", F.lit(0))
    splits = [float("-inf"), *points, float("inf")]
    as_double = df.withColumn("_score", F.col(score).cast("double"))
    parted = Bucketizer(splits=splits, inputCol="_score", outputCol="part", handleInvalid="keep").transform(as_double)
    # whole numbers: windows take floating-point keys for other keys than the layout's
    return parted.drop("_score").withColumn("part", F.col("part").cast("int"))


def score_counts(df: DataFrame, by: Sequence[str], score: str = "y_prob", label: str = "label") -> DataFrame:
    """Rows and positives at each distinct score of each group."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(label).cast("bigint").alias("tp"),
        (F.count(F.lit(1)) - F.sum(label)).alias("fp"),
    )


def ordered_parts(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition by a unique key and pin each row to its part number."""
    laid_out = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    return materialize(laid_out, "ordered")


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], totals: dict[str, str]
) -> DataFrame:
    """Inclusive running sums along ``order`` within each group, plus group totals.

    ``totals`` maps a value column to the name of its running sum; the group
    total is called ``all_<name>``. Part sums are one row per (group, part), at
    most groups + parts rows; they join on the keys the windows need anyway.
    """
    parts = ordered_parts(df, [*[F.col(c) for c in by], *order])
    per_part = parts.groupBy(*by, "part").agg(*[F.sum(c).alias(f"sum_{c}") for c in totals])
    across = Window.partitionBy(*by).orderBy("part")
    whole = Window.partitionBy(*by)
    offsets = per_part.select(
        *by,
        "part",
        *[
            F.coalesce(F.sum(f"sum_{c}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
                f"before_{c}"
            )
            for c in totals
        ],
        *[F.sum(f"sum_{c}").over(whole).alias(f"all_{name}") for c, name in totals.items()],
    )
    inside = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(offsets, [*by, "part"])
    return joined.withColumns(
        {name: F.col(f"before_{c}") + F.sum(c).over(inside) for c, name in totals.items()}
    ).drop("part", *[f"before_{c}" for c in totals])


def curve_from_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Curve from one row per (group, part, score); group columns must not be NULL."""
    per_part = counts.groupBy(*by, "part").agg(F.sum("tp").alias("part_tp"), F.sum("fp").alias("part_fp"))
    higher = Window.partitionBy(*by).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_part.select(
        *by, "part",
        F.coalesce(F.sum("part_tp").over(higher), F.lit(0)).alias("before_tp"),
        F.coalesce(F.sum("part_fp").over(higher), F.lit(0)).alias("before_fp"),
        F.sum("part_tp").over(whole).alias("positives"),
        F.sum("part_fp").over(whole).alias("negatives"),
    )
    inside = Window.partitionBy(*by, "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    curve = counts.withColumns({"cum_tp": F.sum("tp").over(inside), "cum_fp": F.sum("fp").over(inside)}).join(offsets, [*by, "part"])
    totals = {"cum_tp": F.col("before_tp") + F.col("cum_tp"), "cum_fp": F.col("before_fp") + F.col("cum_fp")}
    return curve.withColumns(totals).withColumns(
        {
            "precision": F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")),
            "recall": S.safe_ratio("cum_tp", "positives"),
        }
    ).drop("part", "before_tp", "before_fp")


def pr_curve(df: DataFrame, by: Sequence[str], score: str = "y_prob", label: str = "label") -> DataFrame:
    """Precision and recall at every distinct score, with the counts behind them.

    ``tp``/``fp`` are the counts at the score, ``cum_tp``/``cum_fp`` at or above it.
    """
    parted = with_part(df, split_points(df, score), score)
    return curve_from_counts(score_counts(parted, [*by, "part"], score, label), by)


def roc_auc_of() -> Column:
    """Area under the ROC curve, half credit for ties; NULL with one class only."""
    area = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / F.lit(2.0)))
    # as doubles: the product of two row counts can exceed a bigint
    pairs = F.max("positives").cast("double") * F.max("negatives").cast("double")
    return area / F.nullif(pairs, F.lit(0.0))


def average_precision_of() -> Column:
    """Sum of recall steps times precision; NULL without positives."""
    return F.sum(F.col("tp") * F.col("precision")) / F.nullif(F.max("positives"), F.lit(0))


def curve_areas(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    return curve.groupBy(*by).agg(roc_auc_of().alias("roc_auc"), average_precision_of().alias("pr_auc"))


def roc_auc(df: DataFrame, by: Sequence[str], score: str = "y_prob", label: str = "label") -> DataFrame:
    return pr_curve(df, by, score, label).groupBy(*by).agg(roc_auc_of().alias("roc_auc"))


def average_precision(df: DataFrame, by: Sequence[str], score: str = "y_prob", label: str = "label") -> DataFrame:
    return pr_curve(df, by, score, label).groupBy(*by).agg(average_precision_of().alias("pr_auc"))


def best_f1_of(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    f1 = F.lit(2.0) * p * r / (p + r + F.lit(1e-12))
    # highest F1; among equals the lowest score
    best = curve.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("s"))).alias("best"))
    return best.select(*by, (-F.col("best.s")).alias("optimal_threshold"), F.col("best.f1").alias("best_f1"))


def best_f1_threshold(df: DataFrame, by: Sequence[str], score: str = "y_prob", label: str = "label") -> DataFrame:
    return best_f1_of(pr_curve(df, by, score, label), by)


def exact_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact median of each group: distinct values counted, then ranked in even parts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("copies"))
    ranked = running_totals(counts, by, [F.col(value)], {"copies": "upto"})
    total = F.col("all_upto")
    # 1-based positions of the middle value, or the two middle values
    low, high = F.floor((total + 1) / 2), F.floor(total / 2) + 1
    first = F.col("upto") - F.col("copies") + 1
    holds = lambda pos: (first <= pos) & (pos <= F.col("upto"))
    return ranked.groupBy(*by).agg(
        (
            (F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / F.lit(2.0)
        ).alias("median")
    )
