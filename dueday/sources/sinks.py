"""Writes: Parquet tables, one-file reports, partitioned outputs, caches, manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import HotKeys, hot_keys
from ..schemas import ENTITY, EVENT_ORDER
from ..session import materialize

REPORT_ROWS = 100_000  # to a file


def sink_parquet(df: DataFrame, path: str, sort_within: Sequence[str] = ()) -> DataFrame:
    """Overwrite a table; rows may be ordered inside each file, never globally."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def sort_events(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Events in order: ranges of the order key follow one another, and rows inside them too.

    The key is the whole order, so a borrower with very many events fills several ranges.
    """
    return events.repartitionByRange(*by).sortWithinPartitions(*by)


def sort_outputs(df: DataFrame, by: Sequence[str] = (ENTITY, "snapshot_day")) -> DataFrame:
    """Order rows inside each partition, which is what readers of the files use."""
    return df.sortWithinPartitions(*by)


def sink_csv_report(df: DataFrame, path: str) -> DataFrame:
    """A report as CSV with a header: one file up to ``REPORT_ROWS`` rows, and more
    files, written by as many tasks as the table has parts, beyond that."""
    rows = materialize(df, "report")
    small = rows.limit(REPORT_ROWS + 1).count() <= REPORT_ROWS
    writer = (rows.coalesce(1) if small else rows).write.mode("overwrite")
    writer.option("header", True).option("maxRecordsPerFile", REPORT_ROWS).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def sink_metrics_append(df: DataFrame, path: str, by: Sequence[str] = ("target", "model")) -> DataFrame:
    """Add metric rows; writing the same (target, model) again replaces its rows."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )
    return df.sparkSession.read.parquet(path)


def sink_by_split(df: DataFrame, path: str) -> DataFrame:
    """One directory per split; a filter on ``split`` then reads only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return df.sparkSession.read.parquet(path)


def event_layout(
    events: DataFrame, path: str, key: str = ENTITY, order: Sequence[str] = tuple(EVENT_ORDER), buckets: int | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """Events as a table bucketed by borrower and sorted inside its files.

    Stages that work per borrower read it without a shuffle on the borrower. Rows are dealt to the writing tasks by their
    bucket, so a bucket is one file; a hot borrower's rows are also dealt by a hash of the order, so they
    fill several files of its bucket. There are as many buckets as shuffles have parts unless ``buckets`` says otherwise.
    """
    spark = events.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(events, key) if hot is None else hot
    bucket = F.pmod(F.hash(key), F.lit(buckets))  # what Spark's writer puts the row in
    if hot:
        dealt = events.join(F.broadcast(hot.frame.select(key, F.col("pieces").alias("_pieces"))), key, "left")
        piece = F.pmod(F.xxhash64(*order), F.coalesce("_pieces", F.lit(1)))
        dealt = dealt.repartition(buckets, bucket, piece).drop("_pieces")
    else:
        dealt = events.repartition(buckets, bucket)
    name = f"events_{uuid.uuid4().hex}"
    dealt.select(*events.columns).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(name)
    return spark.table(name)


def family_cache(
    spark: SparkSession, path: str, version: str, build: Callable[[], DataFrame], rebuild: bool = False
) -> DataFrame:
    """A feature family, built once per input ``version``."""
    target = f"{path}/version={version}"
    if not rebuild:
        try:
            return spark.read.parquet(target)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def run_manifest(spark: SparkSession, stage: str, outputs: dict[str, DataFrame], params: dict[str, Any], path: str) -> DataFrame:
    """Write the outputs and ``manifest`` beside them, a JSON file with one row per output: its rows, columns and the run's parameters.

    Rows are counted while they are written, so no output is computed or read a second time.
    """
    text = json.dumps(params, sort_keys=True)
    rows = []
    for name, df in outputs.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("row_count")).write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((stage, name, seen.get["row_count"], len(df.columns), text))
    schema = "stage string, output string, row_count bigint, column_count int, params string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(schema).json(f"{path}/manifest")
