"""Snapshots, features and labels brought together, with join contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import (
    APPLICATION_NUMERIC,
    BUREAU_FEATURES,
    ENTITY,
    HISTORY_FEATURES,
    PREVIOUS_FEATURES,
    SLICE_COLS,
    SNAPSHOT_KEYS,
)
from .labels import hit_ahead, missed_flag, pos_dpd_days
from .skew import HOT_ROWS, HotKeys, hot_keys, lookup, small_tasks
from .timeline import EVENT_COLS, PIECE, WINDOW_DAYS, borrower_timeline, split_hot

FEATURES = [*HISTORY_FEATURES, *APPLICATION_NUMERIC, *SLICE_COLS, *PREVIOUS_FEATURES, *BUREAU_FEATURES]


class CardinalityError(ValueError):
    """A join key that must be unique is not."""


def duplicate_key_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows")).where("key_rows > 1")


def assert_cardinality(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """Raise unless ``keys`` are unique in ``df``; reads at most one offending key."""
    found = duplicate_key_rows(df, keys).limit(1).collect()
    if found:
        raise CardinalityError(f"{name}: key {keys} repeats, e.g. {found[0].asDict()}")
    return df


def join_history_1to1(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """Snapshots with their history features, matched on all six snapshot keys."""
    return snapshots.join(history, SNAPSHOT_KEYS, "left")


def join_entity_features(
    snapshots: DataFrame, entity: DataFrame, hot: HotKeys | None = None, limit: int = HOT_ROWS
) -> DataFrame:
    """Many snapshots to one borrower row; hot borrowers are spread by snapshot."""
    return lookup(snapshots, entity, ENTITY, ["snapshot_id"], hot, limit)


def attach_label(features: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    return features.join(labels.select("snapshot_id", F.col(label).alias("label")), "snapshot_id", "inner")


def tag_and_rename(df: DataFrame, label: str, target: str) -> DataFrame:
    return df.withColumnRenamed(label, "label").withColumn("target_name", F.lit(target))


def model_table(
    events: DataFrame,
    pos: DataFrame,
    entity: DataFrame,
    hot: HotKeys | None = None,
    window_days: int = WINDOW_DAYS,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Snapshot keys, all 56 features and both labels in one table.

    A label is NULL where it is not defined. Labels and history come from the
    same pass over the borrower's events; borrower features are repeated once
    per piece of a hot borrower and join on (borrower, piece), the partitioning
    the windows already have, so the big side is not shuffled for them.
    """
    hot = hot_keys(events, ENTITY, limit) if hot is None else hot
    cut = split_hot(events.select(*EVENT_COLS), hot)
    timeline = borrower_timeline(events, hot, window_days=window_days, cut=cut).select(
        *SNAPSHOT_KEYS,
        *PIECE,
        *HISTORY_FEATURES,
        F.when(F.col("next_DAYS_INSTALMENT").isNotNull(), missed_flag()).alias("missed_upcoming_emi"),
        "borrower_max_installment_day",
        "future_inst_dpd30_hit",
    )
    borrower = entity.join(pos_dpd_days(pos), ENTITY, "full")
    wide = timeline.join(_spread_over_pieces(borrower, cut, hot), [ENTITY, *PIECE], "left")
    complete = F.col("borrower_max_installment_day") >= F.col("snapshot_day") + window_days
    hit = F.greatest("future_inst_dpd30_hit", hit_ahead("pos_days", "snapshot_day", window_days))
    return wide.select(*SNAPSHOT_KEYS, *FEATURES, "missed_upcoming_emi", F.when(complete, hit).alias("future_dpd30"))


def _spread_over_pieces(entity: DataFrame, cut: DataFrame, hot: HotKeys) -> DataFrame:
    """Borrower rows, once per piece for hot borrowers."""
    if not hot:
        return entity.withColumns({piece: F.lit(0) for piece in PIECE})
    pieces = cut.where("is_hot").select(ENTITY, *PIECE).distinct()
    return entity.join(pieces, ENTITY, "left").fillna(0, subset=PIECE)


def target_rows(model: DataFrame, target: str) -> DataFrame:
    """The model table of one target: rows where its label is defined."""
    other = {"missed_upcoming_emi": "future_dpd30", "future_dpd30": "missed_upcoming_emi"}[target]
    return model.where(F.col(target).isNotNull()).drop(other).withColumnRenamed(target, "label")


def interval_exists(
    rows: DataFrame, flagged: DataFrame, days: int, key: str = ENTITY, day: str = "snapshot_day", limit: int = HOT_ROWS
) -> DataFrame:
    """For each row: is there a flagged day of the same key in (day, day + days]?

    Both sides are reduced to distinct (key, day) before they are laid out for the range window, so a key has at most one row per
    calendar day and side there. The answers go back through ``lookup``: the rows of one key and day may be very many. NULL for rows without key or day.
    """
    at = lambda d: F.concat(F.col(key).cast("string"), F.lit(":"), F.col(d).cast("string"))
    rows = rows.withColumn("_at", at(day))
    hot = hot_keys(rows, "_at", limit)
    probe = rows.select(key, F.col(day).alias("day"), F.lit(0).alias("hit"), F.lit(1).alias("probe")).distinct()
    marks = flagged.select(key, F.col(day).alias("day"), F.lit(1).alias("hit"), F.lit(0).alias("probe")).distinct()
    merged = small_tasks(probe.unionByName(marks), hot.rows + flagged.count(), key).groupBy(key, "day").agg(
        F.max("hit").alias("hit"), F.max("probe").alias("probe")
    )
    ahead = Window.partitionBy(key).orderBy("day").rangeBetween(1, days)
    answers = merged.withColumn("exists", F.coalesce(F.max("hit").over(ahead), F.lit(0))).where("probe = 1")
    found = answers.select(at("day").alias("_at"), "exists").where("_at IS NOT NULL")
    return lookup(rows, found, "_at", [c for c in rows.columns if c not in (key, day, "_at")] or [key], hot).drop("_at")


def entity_max_back(
    df: DataFrame, value: str, name: str, key: str = ENTITY, spread_by: list[str] | None = None,
    hot: HotKeys | None = None, limit: int = HOT_ROWS,
) -> DataFrame:
    """The key's maximum beside every row."""
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(name))
    return lookup(df, best, key, spread_by or [value], hot, limit)


def threshold_lookup(scored: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """Tuned threshold per (target, model); the table has one row per model."""
    table = thresholds.select("target", "model", F.col("optimal_threshold").alias("threshold"))
    return scored.join(F.broadcast(table), ["target", "model"], "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(default))
    )
