"""Finding hot keys and keeping their rows spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# A key with more rows than this is hot.
HOT_ROWS = 1_000_000
# Keys a sketch keeps track of. It overlooks no key with more than 7 / TRACKED of the rows, so the limit
# grows with the table beyond HOT_ROWS * TRACKED / 7 rows, and no list of hot keys is longer than TRACKED / 7.
TRACKED = 30_000
MOST_HOT = TRACKED // 7
# Rows a task of a large shuffle holds, and the tasks up to which the session's own settings deal them out.
TASK_ROWS = 250_000
LEAST_TASKS = 16


@dataclass(frozen=True)
class HotKeys:
    """Keys with more than ``limit`` rows, and how many pieces to cut each into."""

    key: str
    frame: DataFrame
    count: int
    null_pieces: int = 0
    limit: int = HOT_ROWS
    rows: int = 0  # of the table they were counted on

    def __bool__(self) -> bool:
        return self.count > 0

    def keys(self) -> DataFrame:
        return F.broadcast(self.frame.select(self.key))


def hot_keys(df: DataFrame, key: str, limit: int = HOT_ROWS) -> HotKeys:
    """The keys with more than ``limit`` rows, or more than 7 / TRACKED of all rows if that is higher.

    This runs one job now: a scan of the key column with a sketch of frequent items, which moves a few sketches and no keys.
    Only if the sketch names candidates, they are counted exactly by a second scan. Knowing the answer
    keeps the plans simple, because without hot keys no plan needs a second path. Rows without a key are
    counted too, as joins would send them all to one task.
    """
    top = F.expr(f"approx_top_k(`{key}`, {MOST_HOT}, {TRACKED})")
    seen = df.agg(top.alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("missing")).first()
    limit = max(limit, -(-7 * seen.n // TRACKED))
    named = [x["item"] for x in seen.top or [] if x["item"] is not None and x["count"] > limit]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}"
    rows = []
    if seen.n // limit > MOST_HOT:  # a limit far below what the sketch tells apart
        counted = df.where(F.col(key).isNotNull())
    else:
        counted = df.join(F.broadcast(df.sparkSession.createDataFrame([(k,) for k in named], schema)), key) if named else None
    if counted is not None:
        sizes = counted.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows")).where(F.col("key_rows") > limit)
        rows = [(r[key], -(-r["key_rows"] // limit)) for r in sizes.collect()]  # at most rows / limit of them
    unnamed = -(-seen.missing // limit) if seen.missing > limit else 0
    return HotKeys(key, df.sparkSession.createDataFrame(rows, f"{schema}, pieces int"), len(rows), unnamed, limit, seen.n)


def many_rows(rows: int) -> bool:
    """Are ``rows`` too many for the session's shuffles, and for a broadcast?"""
    return -(-rows // TASK_ROWS) > LEAST_TASKS


def small_tasks(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` laid out by ``keys`` for at most about TASK_ROWS rows a task, if ``rows`` are too many for the session's shuffles.

    Grouping, windows and joins by the keys use this layout, which AQE does not coalesce, so it adds no shuffle to theirs.
    """
    tasks = -(-rows // TASK_ROWS)
    # with fewer tasks than the session's shuffles have, a join would lay both sides out again
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, least), *keys) if many_rows(rows) else df


def bounded_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, name: str) -> DataFrame:
    """Add ``name``: which run of at most ``limit`` rows, in ``order``, of its key a row belongs to, from 0.

    The rows are laid out by ranges of (keys, order) and written once; a row's place in its key is its place in (key, range)
    plus the rows of the key's earlier ranges, so a key of any size fills many tasks.
    """
    laid = materialize(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "runs")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    shift = sizes.select(*keys, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    joined = laid.withColumn("_place", place).join(shift, [*keys, "_range"])
    run = F.floor((F.col("_place") + F.col("_shift")) / F.lit(limit)).cast("int")
    return joined.withColumn(name, run).drop("_range", "_place", "_shift")


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: Sequence[str],
    hot: HotKeys | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Left join to a table with one row per ``key``, safe for hot keys.

    The left rows of a hot key are cut into ``pieces`` by a hash of
    ``spread_by``; its single right row is repeated once per piece, which adds
    at most 2 * rows / limit rows to the right side. Left rows without a key
    match nothing and are only spread.
    """
    hot = hot_keys(left, key, limit) if hot is None else hot
    if not hot and not hot.null_pieces:
        return left.join(small_tasks(right, hot.rows, key), key, "left")
    pieces = F.broadcast(hot.frame.select(key, F.col("pieces").alias("_pieces")))
    cut = F.when(F.col(key).isNull(), F.lit(max(hot.null_pieces, 1))).otherwise(F.coalesce("_pieces", F.lit(1)))
    spread_left = left.join(pieces, key, "left").withColumn(
        "_piece", F.pmod(F.xxhash64(*spread_by), cut).cast("int")
    )
    spread_right = right.join(pieces, key, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1))
    )
    return (
        spread_left.drop("_pieces")
        .join(spread_right.drop("_pieces"), [key, "_piece"], "left")
        .drop("_piece")
    )
