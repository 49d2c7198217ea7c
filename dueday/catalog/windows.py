"""Ordered operators and sorts."""

from pyspark.sql import functions as F

from ..operators import reports
from ..schemas import HISTORY_FEATURES
from ..sources.sinks import sort_outputs
from ..sources.sinks import sort_events as ordered_events
from .base import query

KEY = "snapshot_id, SK_ID_CURR"


def _history(*features):
    return lambda d: d.history.select("snapshot_id", "SK_ID_CURR", *features)


@query("event_ordinal", "SELECT SK_ID_PREV, SK_ID_CURR, NUM_INSTALMENT_NUMBER, borrower_event_order FROM ov_snap")
def event_ordinal(d):
    return d.snapshots.select("SK_ID_PREV", "SK_ID_CURR", "NUM_INSTALMENT_NUMBER", "borrower_event_order")


NEXT = [
    "next_SK_ID_PREV", "next_NUM_INSTALMENT_VERSION", "next_NUM_INSTALMENT_NUMBER", "next_DAYS_INSTALMENT", "next_first_payment_day",
    "next_AMT_INSTALMENT", "next_total_amount_paid", "next_missing_payment_flag", "next_underpaid_after_aggregation_flag",
    "next_aggregated_payment_delay_days", "next_installment_gap_days",
]


@query("next_event", f"SELECT snapshot_id, {', '.join(NEXT)} FROM ov_snap", next_AMT_INSTALMENT=4, next_total_amount_paid=4)
def next_event(d):
    return d.snapshots.select("snapshot_id", *NEXT)


@query("missed_upcoming_emi", "SELECT * FROM ov_missed")
def missed_upcoming_emi(d):
    return d.missed


@query("future_dpd30", "SELECT * FROM ov_dpd30")
def future_dpd30(d):
    return d.dpd30


COUNTS = HISTORY_FEATURES[:6]
query("hist_running_counts", f"SELECT {KEY}, {', '.join(COUNTS)} FROM ov_hist", hist_delay_mean=6)(_history(*COUNTS))
query("hist_running_max", f"SELECT {KEY}, hist_delay_max FROM ov_hist", hist_delay_max=6)(_history("hist_delay_max"))
query(
    "hist_lag", f"SELECT {KEY}, hist_recent_delay, hist_recent_payment_ratio FROM ov_hist",
    hist_recent_delay=6, hist_recent_payment_ratio=6,
)(_history("hist_recent_delay", "hist_recent_payment_ratio"))
ROLL = HISTORY_FEATURES[9:13]
query("hist_rolling", f"SELECT {KEY}, {', '.join(ROLL)} FROM ov_hist", **{c: 6 for c in ROLL})(_history(*ROLL))
query("hist_streaks", f"SELECT {KEY}, hist_on_time_streak, hist_late_streak FROM ov_hist")(
    _history("hist_on_time_streak", "hist_late_streak")
)
FLOATS = ["hist_delay_mean", "hist_delay_max", "hist_recent_delay", "hist_recent_payment_ratio", *ROLL]


@query("installment_history", "SELECT * FROM ov_hist", **{c: 6 for c in FLOATS})
def installment_history(d):
    return d.history


@query("chronological_split", "SELECT * FROM ov_split")
def chronological_split(d):
    return d.split_map


# --- sorts, limits, top-k --------------------------------------------------


@query("sort_events", "SELECT SK_ID_CURR, DAYS_INSTALMENT, NUM_INSTALMENT_NUMBER, SK_ID_PREV FROM ov_events")
def sort_events(d):
    rows = d.events.select("SK_ID_CURR", "DAYS_INSTALMENT", "NUM_INSTALMENT_NUMBER", "SK_ID_PREV", "NUM_INSTALMENT_VERSION")
    order = ["SK_ID_CURR", "DAYS_INSTALMENT", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION", "SK_ID_PREV"]
    return ordered_events(rows, order).drop("NUM_INSTALMENT_VERSION")


@query("sort_outputs", "SELECT SK_ID_CURR, snapshot_day, snapshot_id FROM ov_missed")
def sort_outputs_(d):
    return sort_outputs(d.missed.select("SK_ID_CURR", "snapshot_day", "snapshot_id"))


@query(
    "sort_mixed",
    "SELECT NAME_YIELD_GROUP, NAME_CONTRACT_STATUS, count(*) AS applications FROM fx_previous GROUP BY 1, 2",
)
def sort_mixed(d):
    counts = d("fx_previous").groupBy("NAME_YIELD_GROUP", "NAME_CONTRACT_STATUS").agg(F.count("*").alias("applications"))
    return reports.sort_mixed(counts, F.desc("applications"), F.asc("NAME_YIELD_GROUP"), F.asc("NAME_CONTRACT_STATUS"))


@query(
    "topk_per_group",
    """SELECT SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER, AMT_INSTALMENT, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY SK_ID_CURR
    ORDER BY AMT_INSTALMENT DESC, SK_ID_PREV, NUM_INSTALMENT_NUMBER) AS INT) AS rank FROM ov_events) x WHERE rank <= 3""",
    AMT_INSTALMENT=4,
)
def topk_per_group(d):
    rows = d.events.select("SK_ID_CURR", "SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "AMT_INSTALMENT")
    order = [F.desc("AMT_INSTALMENT"), F.asc("SK_ID_PREV"), F.asc("NUM_INSTALMENT_NUMBER")]
    return reports.topk_per_group(rows, ["SK_ID_CURR"], order, 3)
