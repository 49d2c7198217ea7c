"""Everything ordered within one borrower: ordinals, next events, history features.

The events of an ordinary borrower are one window partition. A hot borrower
(see :mod:`skew`) is cut into pieces by the leading order columns, due day and
instalment number, and a day and number with very many events into runs of bounded length by version and
contract, so no task ever holds all of its events. Each piece is
computed on its own and then corrected with a *carry*: what the earlier pieces
hand over (row offset, running counts, the last six events) and the first event
of the next piece. The carry has one row per piece of a hot borrower; when
nobody is hot there is no carry and the plan is a single shuffle and sort.

The big side is shuffled once, on (borrower, piece); the carry join uses the
same keys and adds no second shuffle of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import ENTITY, EVENT_ORDER, HISTORY_FEATURES, SNAPSHOT_KEYS
from ..session import materialize
from .skew import HOT_ROWS, HotKeys, bounded_runs, hot_keys, small_tasks

# Fixed value: length of the label's look-ahead.
WINDOW_DAYS = 90

PIECE = ["piece_day", "piece_number", "piece_run"]
PIECE_SOURCE = ["DAYS_INSTALMENT", "NUM_INSTALMENT_NUMBER"]
FIRST = -(2**31)  # piece of a missing order value, which sorts first

NEXT_COLS = [
    "SK_ID_PREV",
    "NUM_INSTALMENT_VERSION",
    "NUM_INSTALMENT_NUMBER",
    "DAYS_INSTALMENT",
    "first_payment_day",
    "AMT_INSTALMENT",
    "total_amount_paid",
    "missing_payment_flag",
    "underpaid_after_aggregation_flag",
    "aggregated_payment_delay_days",
]
EVENT_COLS = [ENTITY, *NEXT_COLS]

# Windows over the last 3 and 6 events; the longest one decides how many events
# a piece hands to the next.
ROLLING = (3, 6)
TAIL = max(ROLLING)

COUNTED = {
    "hist_late_count": "is_late",
    "hist_missed_count": "is_missed",
    "hist_partial_count": "is_partial",
    "hist_on_time_count": "is_on_time",
}
ROLLED = ["delay_sum", "is_late_sum"]
STREAKS = {"hist_on_time_streak": "is_on_time", "hist_late_streak": "is_late"}


def behaviour_flags(events: DataFrame) -> DataFrame:
    """Per-event behaviour; a partial payment can still be on time."""
    late = S.is_late("aggregated_payment_delay_days")
    missed = S.positive("missing_payment_flag")
    return events.withColumns(
        {
            "is_late": late,
            "is_missed": missed,
            "is_partial": S.positive("underpaid_after_aggregation_flag"),
            "is_on_time": S.flag((late == 0) & (missed == 0)),
            "payment_ratio": S.safe_ratio("total_amount_paid", "AMT_INSTALMENT"),
            "delay_nonnull": F.coalesce("aggregated_payment_delay_days", F.lit(0)),
            "is_dpd30": S.instalment_dpd30("aggregated_payment_delay_days"),
        }
    )


def split_hot(events: DataFrame, hot: HotKeys) -> DataFrame:
    """Add the piece columns: (0, 0, 0) for ordinary borrowers; due day, number and a run of at most
    ``hot.limit`` events for hot ones.

    An event must name its borrower; one without fails the job. Days and numbers with more events than the limit are
    counted first, for hot borrowers only; there can be at most rows / limit of them.
    """
    # a filter keeps the column as it is, and with it the layout of a bucketed table
    events = events.where(F.col(ENTITY).isNotNull() | F.raise_error(F.lit(f"an event has no {ENTITY}")).cast("boolean"))
    if not hot:
        return events.withColumns({piece: F.lit(0) for piece in PIECE})
    tagged = events.join(hot.keys().withColumn("is_hot", F.lit(True)), ENTITY, "left")
    day, number, run = PIECE
    cut = tagged.withColumns(
        {
            piece: F.when(F.col("is_hot"), F.coalesce(source, F.lit(FIRST))).otherwise(F.lit(0))
            for piece, source in zip(PIECE, PIECE_SOURCE)
        }
    )
    key = [ENTITY, day, number]
    sizes = cut.where("is_hot").groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot.limit)
    long = materialize(sizes.select(*key, F.lit(True).alias("is_long")), "long-pieces")
    if not long.take(1):
        return cut.withColumn(run, F.lit(0))
    marked = cut.join(F.broadcast(long), key, "left")
    short = marked.where("is_long IS NULL").withColumn(run, F.lit(0)).drop("is_long")
    runs = bounded_runs(marked.where("is_long").drop("is_long"), key, EVENT_ORDER, hot.limit, run)
    return short.unionByName(runs)


def piece_window() -> Window:
    return Window.partitionBy(ENTITY, *PIECE).orderBy(*EVENT_ORDER)


def _before(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _in_piece(events: DataFrame, window_days: int) -> DataFrame:
    """All windows that look only inside one piece; they share one sort.

    Every value is a column of its own, so that unused ones are dropped, and
    running sums replace sliding frames, which Spark adds up again row by row.
    """
    w = piece_window()
    before = _before(w)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = Window.partitionBy(ENTITY, *PIECE).orderBy("DAYS_INSTALMENT").rangeBetween(1, window_days)
    cols: dict[str, Column] = {
        "rn": F.row_number().over(w),
        "has_next": F.lead(F.lit(True)).over(w),
        **{f"lead_{c}": F.lead(c).over(w) for c in NEXT_COLS},
        "lag_delay": F.lag("aggregated_payment_delay_days").over(w),
        "lag_ratio": F.lag("payment_ratio").over(w),
        "delay_sum": F.coalesce(F.sum("delay_nonnull").over(before), F.lit(0)),
        "delay_max": F.max("delay_nonnull").over(before),
        "last_day": F.max("DAYS_INSTALMENT").over(whole),
        "dpd30_ahead": F.max("is_dpd30").over(ahead),
        **{f"{f}_sum": F.coalesce(F.sum(f).over(before), F.lit(0)) for f in COUNTED.values()},
    }
    # Over the results: the sum n rows ago, and the last row that broke a streak.
    second: dict[str, Column] = {
        f"{f}_break": F.max(F.when(F.col(f) == 0, F.col("rn"))).over(before) for f in STREAKS.values()
    }
    for n in ROLLING:
        for name in ROLLED:
            second[f"{name}_{n}"] = F.col(name) - F.coalesce(F.lag(name, n).over(w), F.lit(0))
    return events.withColumns(cols).withColumns(second)


def piece_carry(hot_rows: DataFrame, window_days: int) -> DataFrame:
    """One row per piece of a hot borrower: what the pieces around it hand over."""
    w = piece_window()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = hot_rows.withColumns(
        {"rn": F.row_number().over(w), "left_in_piece": F.count(F.lit(1)).over(whole)}
    ).withColumn("left_in_piece", F.col("left_in_piece") - F.col("rn"))
    tail_row = F.struct("rn", "delay_nonnull", "is_late", "aggregated_payment_delay_days", "payment_ratio")
    pieces = numbered.groupBy(ENTITY, *PIECE).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("delay_nonnull").alias("delay_sum"),
        F.max("delay_nonnull").alias("delay_max"),
        F.max("is_dpd30").alias("is_dpd30"),
        *[F.sum(f).alias(f"{f}_sum") for f in COUNTED.values()],
        *[F.max(F.when(F.col(f) == 0, F.col("rn"))).alias(f"{f}_break") for f in STREAKS.values()],
        # at most six structs
        F.sort_array(F.collect_list(F.when(F.col("left_in_piece") < TAIL, tail_row))).alias("tail"),
        F.min(F.when(F.col("rn") == 1, F.struct(*NEXT_COLS))).alias("head"),
    )
    # One row per (due day, instalment number, run) of a borrower: bounded by the
    # calendar and by events / limit.
    across = Window.partitionBy(ENTITY).orderBy(*PIECE)
    before = _before(across)
    carried = pieces.withColumns(
        {
            "offset": F.coalesce(F.sum("rows").over(before), F.lit(0)),
            "next_head": F.lead("head").over(across),
            # a piece has one due day, so its range window is the borrower's
            "piece_dpd30_ahead": F.max("is_dpd30").over(
                Window.partitionBy(ENTITY).orderBy(PIECE[0]).rangeBetween(1, window_days)
            ),
            "borrower_last_day": F.max(PIECE[0]).over(Window.partitionBy(ENTITY)),
            "prior_delay_sum": F.sum("delay_sum").over(before),
            "prior_delay_max": F.max("delay_max").over(before),
            **{f"prior_{f}_sum": F.sum(f"{f}_sum").over(before) for f in COUNTED.values()},
            # six earlier pieces hold at least six events, or all there are
            "tail": F.slice(
                F.reverse(F.flatten(F.collect_list("tail").over(across.rowsBetween(-TAIL, -1)))), 1, TAIL
            ),
        }
    ).withColumns(
        {
            f"prior_{f}_break": F.max(F.col("offset") + F.col(f"{f}_break")).over(before)
            for f in STREAKS.values()
        }
    )

    def newest(field: str) -> Column:
        """Sums over the newest 1, 2, ... 6 carried events."""
        return F.transform(
            F.sequence(F.lit(1), F.lit(TAIL)),
            lambda k: F.aggregate(
                F.slice("tail", 1, k), F.lit(0).cast("bigint"), lambda acc, row: acc + row[field]
            ),
        )

    return carried.select(
        ENTITY,
        *PIECE,
        "offset",
        "next_head",
        "piece_dpd30_ahead",
        "borrower_last_day",
        "prior_delay_sum",
        "prior_delay_max",
        *[f"prior_{f}_sum" for f in COUNTED.values()],
        *[f"prior_{f}_break" for f in STREAKS.values()],
        F.get("tail", F.lit(0)).alias("prior_event"),
        newest("delay_nonnull").alias("prior_delays"),
        newest("is_late").alias("prior_lates"),
    )


def borrower_timeline(
    events: DataFrame, hot: HotKeys | None = None, limit: int = HOT_ROWS, window_days: int = WINDOW_DAYS,
    cut: DataFrame | None = None,
) -> DataFrame:
    """Snapshots with next-event columns and the 15 history features in one pass.

    Also per row: is there an instalment 30+ days late due in (day, day +
    window], and the borrower's last due day.

    Callers select what they need; Catalyst drops the unused windows. Every
    feature looks strictly before its row, so a borrower's first row has no
    history. ``hot`` may be counted on any table with at least as many rows per
    borrower, such as the raw payments. ``cut``: the events with their pieces, if the caller has them.
    """
    hot = hot_keys(events, ENTITY, limit) if hot is None else hot
    flagged = behaviour_flags(split_hot(events.select(*EVENT_COLS), hot) if cut is None else cut)
    flagged = small_tasks(flagged, hot.rows, ENTITY, *(PIECE if hot else []))
    rows = _in_piece(flagged, window_days)
    if hot:
        rows = rows.join(piece_carry(flagged.where("is_hot"), window_days), [ENTITY, *PIECE], "left")

    def carried(name: str) -> list[Column]:
        return [F.col(name)] if hot else []

    zero = F.lit(0)
    seen = F.col("rn") - 1
    offset = F.coalesce(*carried("offset"), zero)
    ordinal = seen + offset

    def plus(inside: str, prior: str) -> Column:
        return sum((F.coalesce(c, zero) for c in carried(prior)), F.col(inside))

    def rolling(inside: str, prior: str, n: int) -> Column:
        # the first n rows of a piece reach back into the carried events
        reach = [F.coalesce(F.when(seen < n, F.get(c, F.lit(n - 1) - seen)), zero) for c in carried(prior)]
        return sum(reach, F.col(inside))

    def streak(f: str) -> Column:
        return ordinal - F.coalesce(offset + F.col(f"{f}_break"), *carried(f"prior_{f}_break"), zero)

    def following(field: str) -> Column:
        # the last row of a piece looks at the head of the next one
        inside = F.col(f"lead_{field}")
        return F.when(F.col("has_next"), inside).otherwise(F.col("next_head")[field]) if hot else inside

    def recent(field: str, inside: str) -> Column:
        return F.when(seen == 0, F.col("prior_event")[field]).otherwise(F.col(inside)) if hot else F.col(inside)

    features: dict[str, Column] = {
        "hist_total_installments": ordinal.cast("int"),
        **{name: plus(f"{f}_sum", f"prior_{f}_sum").cast("int") for name, f in COUNTED.items()},
        "hist_delay_mean": S.safe_ratio(plus("delay_sum", "prior_delay_sum"), ordinal),
        "hist_delay_max": F.greatest(F.col("delay_max"), *(carried("prior_delay_max") or [F.col("delay_max")])).cast(
            "double"
        ),
        "hist_recent_delay": recent("aggregated_payment_delay_days", "lag_delay").cast("double"),
        "hist_recent_payment_ratio": recent("payment_ratio", "lag_ratio"),
        **{name: streak(f).cast("int") for name, f in STREAKS.items()},
    }
    for n in ROLLING:
        # the mean divides by the window length even when fewer events exist
        features[f"hist_delay_mean_last_{n}"] = rolling(f"delay_sum_{n}", "prior_delays", n) / F.lit(float(n))
        features[f"hist_late_count_last_{n}"] = rolling(f"is_late_sum_{n}", "prior_lates", n).cast("double")

    day = F.col("DAYS_INSTALMENT")
    return rows.select(
        S.snapshot_id(ENTITY, ordinal).alias("snapshot_id"),
        ordinal.cast("int").alias("borrower_event_order"),
        day.alias("snapshot_day"),
        S.month_of_day(day).alias("snapshot_month_approx"),
        *EVENT_COLS,
        *PIECE,
        *[following(c).alias(f"next_{c}") for c in NEXT_COLS],
        S.flag(following("DAYS_INSTALMENT").isNotNull()).alias("has_next_installment"),
        (following("DAYS_INSTALMENT") - day).alias("next_installment_gap_days"),
        F.coalesce(*carried("borrower_last_day"), F.col("last_day")).alias("borrower_max_installment_day"),
        F.coalesce(*carried("piece_dpd30_ahead"), F.col("dpd30_ahead"), zero).alias("future_inst_dpd30_hit"),
        *[features[name].alias(name) for name in HISTORY_FEATURES],
    )


def build_snapshots(
    events: DataFrame, hot: HotKeys | None = None, limit: int = HOT_ROWS, window_days: int = WINDOW_DAYS
) -> DataFrame:
    """One row per (borrower, event) with the following event and the look-ahead beside it."""
    return borrower_timeline(events, hot, limit, window_days).drop(*HISTORY_FEATURES, *PIECE)


def installment_history(events: DataFrame, hot: HotKeys | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """Snapshot keys and the 15 leakage-safe history features."""
    return borrower_timeline(events, hot, limit).select(*SNAPSHOT_KEYS, *HISTORY_FEATURES)
