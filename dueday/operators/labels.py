"""Two forward-looking labels per borrower-time snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import ENTITY, SNAPSHOT_KEYS
from .skew import HOT_ROWS, HotKeys, lookup
from .timeline import WINDOW_DAYS

MISSED_COLS = [
    "snapshot_id",
    "SK_ID_CURR",
    "SK_ID_PREV",
    "borrower_event_order",
    "snapshot_day",
    "snapshot_month_approx",
    "DAYS_INSTALMENT",
    "first_payment_day",
    "aggregated_payment_delay_days",
    "missing_payment_flag",
    "underpaid_after_aggregation_flag",
    "next_SK_ID_PREV",
    "next_NUM_INSTALMENT_NUMBER",
    "next_DAYS_INSTALMENT",
    "next_first_payment_day",
    "next_aggregated_payment_delay_days",
    "next_missing_payment_flag",
    "next_underpaid_after_aggregation_flag",
    "next_installment_gap_days",
]


def filter_has_next(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(F.col("next_DAYS_INSTALMENT").isNotNull())


def missed_flag() -> Column:
    """Is the next event missing, underpaid or late?"""
    return S.flag(
        (S.positive("next_missing_payment_flag") == 1)
        | (S.positive("next_underpaid_after_aggregation_flag") == 1)
        | (S.is_late("next_aggregated_payment_delay_days") == 1)
    )


def missed_upcoming_emi(snapshots: DataFrame) -> DataFrame:
    return filter_has_next(snapshots).select(
        *MISSED_COLS,
        missed_flag().alias("missed_upcoming_emi"),
        F.lit(1).alias("target_available_flag"),
        F.lit("missed_upcoming_emi").alias("target_name"),
    )


def pos_dpd_days(pos: DataFrame) -> DataFrame:
    """(borrower, pos_days): the days of balance months 30+ days past due.

    Only flagged months are kept, and a borrower has one entry per calendar
    month at most, so the array stays short however many loans there are.
    """
    flagged = pos.where(S.pos_dpd30("SK_DPD", "SK_DPD_DEF") == 1)
    return flagged.groupBy(ENTITY).agg(
        F.sort_array(F.collect_set(S.day_of_month("MONTHS_BALANCE").cast("int"))).alias("pos_days")
    )


def hit_ahead(days: str, day: str, window_days: int) -> Column:
    """Does the array hold a day in (day, day + window]?"""
    start = F.col(day)
    found = F.exists(days, lambda x: (x > start) & (x <= start + window_days))
    return F.coalesce(found, F.lit(False)).cast("int")


def limit_entities(df: DataFrame, k: int, key: str = ENTITY) -> DataFrame:
    """Rows of the first ``k`` keys in key order."""
    first = df.select(key).distinct().orderBy(key).limit(k)
    # k bounds the list; a very long one is left to the planner
    return df.join(F.broadcast(first) if k <= HOT_ROWS else first, key, "left_semi")


def filter_complete_window(snapshots: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Snapshots whose borrower has an event at or after the end of the window."""
    return snapshots.where(F.col("borrower_max_installment_day") >= F.col("snapshot_day") + window_days)


def future_dpd30(
    snapshots: DataFrame,
    pos: DataFrame,
    window_days: int = WINDOW_DAYS,
    limit_borrowers: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Any instalment or balance month 30+ days past due within the window.

    ``snapshots`` must be built for the same ``window_days``. They already are
    partitioned by borrower, so the join to the balance days moves only those.
    """
    if limit_borrowers is not None:
        snapshots = limit_entities(snapshots, limit_borrowers)
    rows = filter_complete_window(snapshots, window_days).select(
        *SNAPSHOT_KEYS, "borrower_max_installment_day", "future_inst_dpd30_hit"
    )
    joined = lookup(rows, pos_dpd_days(pos), ENTITY, ["snapshot_id"], hot)
    pos_hit = hit_ahead("pos_days", "snapshot_day", window_days)
    return joined.select(
        *SNAPSHOT_KEYS,
        "borrower_max_installment_day",
        F.lit(1).alias("future_window_complete_flag"),
        "future_inst_dpd30_hit",
        pos_hit.alias("future_pos_dpd30_hit"),
        F.greatest("future_inst_dpd30_hit", pos_hit).alias("future_dpd30"),
        F.lit(1).alias("target_available_flag"),
        F.lit("future_dpd30").alias("target_name"),
    )


def both_labels(
    snapshots: DataFrame, pos: DataFrame, window_days: int = WINDOW_DAYS, hot: HotKeys | None = None
) -> DataFrame:
    """Snapshot keys and both labels, from one pass over the snapshots; a label is NULL where it is not defined."""
    missed = F.when(F.col("next_DAYS_INSTALMENT").isNotNull(), missed_flag())
    complete = F.col("borrower_max_installment_day") >= F.col("snapshot_day") + window_days
    rows = snapshots.select(*SNAPSHOT_KEYS, missed.alias("missed_upcoming_emi"), complete.alias("complete"), "future_inst_dpd30_hit")
    joined = lookup(rows, pos_dpd_days(pos), ENTITY, ["snapshot_id"], hot)
    hit = F.greatest("future_inst_dpd30_hit", hit_ahead("pos_days", "snapshot_day", window_days))
    return joined.select(*SNAPSHOT_KEYS, "missed_upcoming_emi", F.when(F.col("complete"), hit).alias("future_dpd30"))


def target_summary(labels: DataFrame, targets: Sequence[str] = ("missed_upcoming_emi", "future_dpd30")) -> DataFrame:
    """Rows, positives and positive rate of each label column; rows without the label do not count. One aggregation of one row."""
    told = [
        F.struct(
            F.lit(t).alias("target_name"), F.count(t).alias("row_count"),
            F.sum(t).cast("bigint").alias("positive_count"), F.avg(t).alias("positive_rate"),
        ).alias(f"t{i}")
        for i, t in enumerate(targets)
    ]
    return labels.agg(*told).select(F.inline(F.array(*[f"t{i}" for i in range(len(targets))])))


def label_value_counts(labels: DataFrame, label: str) -> DataFrame:
    return labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("row_count"))
