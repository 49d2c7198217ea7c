"""Audit tables over the raw data: keys, duplicates, missing values, anomalies."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..schemas import AUDIT_KEYS


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _key_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))


def audit_summary(tables: Mapping[str, DataFrame], keys: dict[str, list[str]] = AUDIT_KEYS) -> DataFrame:
    """Rows, columns, key, extra rows per key and rows with a missing key part.

    One grouping per table on its key; the counts fall out of the groups.
    """
    rows = []
    for name, df in tables.items():
        key = keys[name]
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        rows.append(
            _key_groups(df, key)
            .agg(
                F.coalesce(F.sum("key_rows"), F.lit(0)).alias("row_count"),
                F.coalesce(F.sum(F.col("key_rows") - 1), F.lit(0)).alias("duplicate_key_count"),
                F.coalesce(F.sum(F.when(missing, F.col("key_rows"))), F.lit(0)).alias("key_missing_count"),
            )
            .select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(df.columns)).alias("column_count"),
                "duplicate_key_count",
                F.lit("|".join(key)).alias("primary_key"),
                "key_missing_count",
            )
        )
    return union_all(rows)


def duplicate_summary(tables: Mapping[str, DataFrame], keys: dict[str, list[str]] = AUDIT_KEYS) -> DataFrame:
    """Rows beyond the first of each key."""
    return union_all(
        [
            _key_groups(df, keys[name])
            .agg(F.coalesce(F.sum(F.col("key_rows") - 1), F.lit(0)).alias("duplicate_count"))
            .select(
                F.lit(name).alias("table_name"),
                F.lit("|".join(keys[name])).alias("duplicate_check"),
                "duplicate_count",
            )
            for name, df in tables.items()
        ]
    )


def missing_summary(df: DataFrame, table_name: str, dtypes: bool = False) -> DataFrame:
    """NULL count and share per column from a single pass over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    long = counts.unpivot("total_rows", df.columns, "column_name", "missing_count")
    out = long.select(
        F.lit(table_name).alias("table_name"),
        "column_name",
        "missing_count",
        (F.col("total_rows") - F.col("missing_count")).alias("present_count"),
        S.safe_ratio("missing_count", "total_rows").alias("missing_pct"),
    )
    if dtypes:
        out = out.withColumn("dtype", S.mapped("column_name", dict(df.dtypes), unknown="", missing=""))
    return out


def sorted_missing(summary: DataFrame) -> DataFrame:
    return summary.orderBy("table_name", F.desc("missing_pct"), "column_name")


def feature_quality(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([missing_summary(df, name, dtypes=True) for name, df in tables.items()])


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Minimum, maximum and mean of the non-NULL values of each numeric column."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    # one scan, one row; array of structs instead of three unpivots
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.avg(c).alias("mean"),
            ).alias(c)
            for c in columns
        ]
    )
    return stats.select(F.inline(F.array(*columns)))


def sequence_integrity(df: DataFrame, key: str = "SK_ID_PREV", position: str = "MONTHS_BALANCE") -> DataFrame:
    """Keys whose number of positions differs from the number of distinct positions.

    The rows are first counted per (key, position), so a heavy key is reduced
    before it meets in one task.
    """
    counted = (
        df.where(F.col(key).isNotNull() & F.col(position).isNotNull())
        .groupBy(key, position)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return (
        counted.groupBy(key)
        .agg(F.sum("copies").alias("position_count"), F.count(F.lit(1)).alias("distinct_count"))
        .where("position_count <> distinct_count")
    )


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both tables, and in the right one only: one grouping, no join."""
    sides = left.select(key, F.lit(1).alias("in_left"), F.lit(0).alias("in_right")).unionByName(
        right.select(key, F.lit(0).alias("in_left"), F.lit(1).alias("in_right"))
    )
    per_key = (
        sides.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))
    )
    return per_key.agg(
        F.count_if((F.col("in_left") == 1) & (F.col("in_right") == 1)).alias("linked_key_count"),
        F.count_if((F.col("in_left") == 0) & (F.col("in_right") == 1)).alias("unmatched_key_count"),
    )


def anomaly_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, check, value) rows behind the anomaly notes."""
    overlap = key_overlap(tables["bureau"], tables["bureau_balance"], "SK_ID_BUREAU")

    def row(df: DataFrame, table: str, check: str, value) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), value.alias("value"))

    sentinel = tables["application_train"].agg(
        F.count_if(F.col("DAYS_EMPLOYED") == S.EMPLOYED_PLACEHOLDER).alias("n")
    )
    broken = sequence_integrity(tables["POS_CASH_balance"]).agg(F.count(F.lit(1)).alias("n"))
    pairs = overlap.unpivot([], ["linked_key_count", "unmatched_key_count"], "check_name", "value")
    return union_all(
        [
            row(sentinel, "application_train", "employment_placeholder", F.col("n")),
            row(broken, "POS_CASH_balance", "broken_sequences", F.col("n")),
            pairs.select(F.lit("bureau_balance").alias("table_name"), "check_name", "value"),
        ]
    )
