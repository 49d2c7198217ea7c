"""Chronological train / validation / test split on distinct days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import ENTITY

# Shares of distinct days, not of rows.
TRAIN_SHARE = 0.70
VALIDATION_SHARE = 0.15


def distinct_days(df: DataFrame, day: str = "snapshot_day") -> DataFrame:
    return df.where(F.col(day).isNotNull()).select(day).distinct()


def chronological_split(
    df: DataFrame, day: str = "snapshot_day", train: float = TRAIN_SHARE, validation: float = VALIDATION_SHARE
) -> DataFrame:
    """(day, split) map: the first 70 % of distinct days train, the next 15 % validate.

    The numbering window has no partition key because it runs over distinct
    calendar days, a few thousand rows whatever the size of ``df``. Fewer than
    three days cannot be split and raise when the map is read.
    """
    every = Window.partitionBy()
    days = distinct_days(df, day).select(
        day,
        F.row_number().over(Window.orderBy(day)).alias("position"),
        F.count(F.lit(1)).over(every).alias("total"),
    )
    total = F.col("total").cast("double")
    train_end = F.least(F.greatest(F.floor(total * train), F.lit(1)), F.col("total") - 2)
    valid_end = F.least(
        F.greatest(F.floor(total * (train + validation)), F.col("train_end") + 1), F.col("total") - 1
    )
    marked = days.withColumn("train_end", train_end).withColumn("valid_end", valid_end)
    name = (
        F.when(F.col("total") < 3, F.raise_error(F.lit("a chronological split needs at least 3 distinct days")))
        .when(F.col("position") <= F.col("train_end"), "train")
        .when(F.col("position") <= F.col("valid_end"), "validation")
        .otherwise("test")
    )
    return marked.select(day, name.cast("string").alias("split"))


def join_split_map(df: DataFrame, split_map: DataFrame, day: str = "snapshot_day") -> DataFrame:
    """Attach the split; a day missing from the map fails the job.

    The map has one row per calendar day, so it is broadcast.
    """
    joined = df.join(F.broadcast(split_map), day, "left")
    checked = F.coalesce("split", F.raise_error(F.lit("a row has a day outside the split map")).cast("string"))
    return joined.withColumn("split", checked)


def split_summary(df: DataFrame, label: str = "label", by: tuple[str, ...] = ("split",)) -> DataFrame:
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum(label).alias("positive_count"),
            F.countDistinct(ENTITY).alias("borrower_count"),
            F.min("snapshot_day").alias("snapshot_day_min"),
            F.max("snapshot_day").alias("snapshot_day_max"),
        )
        .withColumn("positive_rate", S.safe_ratio("positive_count", "row_count"))
    )


def split_entity_overlap(df: DataFrame, key: str = ENTITY) -> DataFrame:
    """Borrowers that appear in two splits, counted in one shuffle."""

    def seen(split: str) -> Column:
        return F.max(F.col("split") == split)

    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        seen("train").alias("tr"), seen("validation").alias("va"), seen("test").alias("te")
    )
    return per_key.agg(
        F.count_if(F.col("tr") & F.col("va")).alias("train_validation_overlap"),
        F.count_if(F.col("tr") & F.col("te")).alias("train_test_overlap"),
        F.count_if(F.col("va") & F.col("te")).alias("validation_test_overlap"),
    )
