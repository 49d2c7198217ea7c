"""Joins, set operations and distinct."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assemble, audit, entity, splits
from ..operators.metrics import slice_counts
from ..operators.reports import federation_gap
from ..schemas import SLICE_COLS, SNAPSHOT_KEYS
from .base import SINGLE, query
from .evaluation import comparison

HIST = "hist_late_count, hist_delay_mean, hist_on_time_streak"


@query(
    "join_history_1to1",
    f"SELECT m.snapshot_id, m.missed_upcoming_emi, {HIST} FROM ov_missed m LEFT JOIN ov_hist h ON m.snapshot_id = h.snapshot_id AND m.SK_ID_PREV = h.SK_ID_PREV",
    hist_delay_mean=6,
)
def join_history_1to1(d):
    left = d.missed.select(*SNAPSHOT_KEYS, "missed_upcoming_emi")
    return assemble.join_history_1to1(left, d.history).select("snapshot_id", "missed_upcoming_emi", *HIST.split(", "))


ENTITY_PICK = "CODE_GENDER, AMT_CREDIT, prev_application_count, prev_credit_mean, bureau_record_count, bureau_bb_dpd_month_count"


@query(
    "join_entity_features",
    f"""SELECT m.snapshot_id, {ENTITY_PICK} FROM ov_missed m LEFT JOIN ov_app_features a ON m.SK_ID_CURR = a.SK_ID_CURR
    LEFT JOIN ov_prev_features p ON m.SK_ID_CURR = p.SK_ID_CURR LEFT JOIN ov_bureau_features b ON m.SK_ID_CURR = b.SK_ID_CURR""",
    AMT_CREDIT=4, prev_credit_mean=SINGLE,
)
def join_entity_features(d):
    left = d.missed.select("snapshot_id", "SK_ID_CURR")
    return assemble.join_entity_features(left, d.entity, d.hot).select("snapshot_id", *ENTITY_PICK.split(", "))


@query(
    "attach_label",
    "SELECT h.snapshot_id, hist_late_count, future_dpd30 AS label FROM ov_hist h JOIN ov_dpd30 d ON h.snapshot_id = d.snapshot_id",
)
def attach_label(d):
    return assemble.attach_label(d.history.select("snapshot_id", "hist_late_count"), d.dpd30, "future_dpd30")


MODEL_DIGITS = {
    **{c: 6 for c in ("hist_delay_mean", "hist_recent_payment_ratio", "hist_delay_mean_last_3", "hist_delay_mean_last_6",
                      "CREDIT_TO_INCOME_RATIO", "ANNUITY_TO_INCOME_RATIO", "GOODS_TO_CREDIT_RATIO", "prev_approval_rate",
                      "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")},
    **{c: 4 for c in ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_GOODS_PRICE", "prev_credit_max")},
    **{c: SINGLE for c in ("prev_credit_mean", "prev_annuity_mean", "prev_down_payment_mean", "bureau_credit_sum_mean",
                           "bureau_credit_sum_debt_mean", "bureau_max_overdue_mean")},
    "AMT_ANNUITY": 5,
    "AGE_YEARS": 2, "EMPLOYMENT_YEARS": 2,
}


@query("model_table", "SELECT * FROM ov_model", **MODEL_DIGITS)
def model_table(d):
    return d.model


@query(
    "join_preagg",
    """SELECT b.SK_ID_BUREAU, b.SK_ID_CURR, CREDIT_ACTIVE, bb_record_count, bb_any_dpd, bb_any_dpd30, bb_dpd_month_count
    FROM fx_bureau b LEFT JOIN ov_bb ON b.SK_ID_BUREAU = ov_bb.SK_ID_BUREAU""",
)
def join_preagg(d):
    bureau = d("fx_bureau").select("SK_ID_BUREAU", "SK_ID_CURR", "CREDIT_ACTIVE")
    return entity.join_preagg(bureau, entity.bureau_balance_agg(d.balance))


@query(
    "entity_max_back",
    """SELECT SK_ID_PREV, SK_ID_CURR, NUM_INSTALMENT_NUMBER, DAYS_INSTALMENT,
    max(DAYS_INSTALMENT) OVER (PARTITION BY SK_ID_CURR) AS borrower_max_installment_day FROM ov_events""",
)
def entity_max_back(d):
    keys = ["SK_ID_PREV", "SK_ID_CURR", "NUM_INSTALMENT_NUMBER"]
    rows = d.events.select(*keys, "DAYS_INSTALMENT")
    return assemble.entity_max_back(
        rows, "DAYS_INSTALMENT", "borrower_max_installment_day", spread_by=keys, hot=d.hot
    ).select(*keys, "DAYS_INSTALMENT", "borrower_max_installment_day")


@query("join_split_map", "SELECT snapshot_id, snapshot_day, label, split FROM ov_missed_split")
def join_split_map(d):
    rows = d.missed_rows.select("snapshot_id", "snapshot_day", "label")
    return splits.join_split_map(rows, d.split_map).select("snapshot_id", "snapshot_day", "label", "split")


@query("interval_exists", "SELECT snapshot_id, SK_ID_CURR, snapshot_day, future_pos_dpd30_hit AS hit FROM ov_hits")
def interval_exists(d):
    marks = (
        d("fx_pos")
        .where(S.pos_dpd30("SK_DPD", "SK_DPD_DEF") == 1)
        .select("SK_ID_CURR", S.day_of_month("MONTHS_BALANCE").alias("snapshot_day"))
    )
    rows = d.snapshots.select("snapshot_id", "SK_ID_CURR", "snapshot_day")
    return assemble.interval_exists(rows, marks, 90).select(
        "snapshot_id", "SK_ID_CURR", "snapshot_day", F.col("exists").alias("hit")
    )


@query(
    "join_next_event",
    """SELECT snapshot_id, SK_ID_PREV, next_SK_ID_PREV, next_NUM_INSTALMENT_NUMBER, next_DAYS_INSTALMENT, next_first_payment_day,
    next_AMT_INSTALMENT, has_next_installment, next_installment_gap_days FROM ov_snap""",
)
def join_next_event(d):
    return d.snapshots.select(
        "snapshot_id", "SK_ID_PREV", "next_SK_ID_PREV", "next_NUM_INSTALMENT_NUMBER", "next_DAYS_INSTALMENT",
        "next_first_payment_day", "next_AMT_INSTALMENT", "has_next_installment", "next_installment_gap_days",
    )


@query(
    "assert_cardinality",
    "SELECT l_orderkey AS SK_ID_PREV, l_linenumber AS NUM_INSTALMENT_NUMBER, count(*) AS key_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) > 1",
)
def assert_cardinality(d):
    assemble.assert_cardinality(d.events, ["SK_ID_PREV", "SK_ID_CURR", "NUM_INSTALMENT_VERSION", "NUM_INSTALMENT_NUMBER"])
    return assemble.duplicate_key_rows(d("fx_installments"), ["SK_ID_PREV", "NUM_INSTALMENT_NUMBER"])


@query(
    "threshold_lookup",
    "SELECT p.model, SK_ID_CURR, ord, CASE WHEN p.model = 'rf' THEN 0.55E0 ELSE 0.5E0 END AS threshold FROM fx_pred p",
)
def threshold_lookup(d):
    only_rf = d("fx_threshold").where("model = 'rf'")
    return assemble.threshold_lookup(d("fx_pred"), only_rf).select("model", "SK_ID_CURR", "ord", "threshold")


@query(
    "federation_gap",
    """SELECT *, federated_roc_auc - centralized_roc_auc AS gap FROM (SELECT target, model, max(roc_auc) FILTER (federation = 'centralized') AS centralized_roc_auc,
    max(roc_auc) FILTER (federation = 'federated') AS federated_roc_auc, max(roc_auc) FILTER (federation = 'local') AS local_best_roc_auc,
    min(roc_auc) FILTER (federation = 'local') AS local_worst_roc_auc FROM ov_comparison GROUP BY 1, 2) g""",
    centralized_roc_auc=6, federated_roc_auc=6, local_best_roc_auc=6, local_worst_roc_auc=6, gap=6,
)
def federation_gap_(d):
    return federation_gap(comparison(d))


# --- sets and distinct -----------------------------------------------------


@query(
    "key_overlap",
    """SELECT (SELECT count(*) FROM (SELECT SK_ID_BUREAU FROM fx_bureau INTERSECT SELECT SK_ID_BUREAU FROM fx_bureau_balance) a) AS linked_key_count,
    (SELECT count(*) FROM (SELECT SK_ID_BUREAU FROM fx_bureau_balance EXCEPT SELECT SK_ID_BUREAU FROM fx_bureau) b) AS unmatched_key_count""",
)
def key_overlap(d):
    return audit.key_overlap(d("fx_bureau"), d("fx_bureau_balance"), "SK_ID_BUREAU")


def _overlap(a: str, b: str) -> str:
    pick = "SELECT SK_ID_CURR FROM ov_missed_split WHERE split = '{}'"
    return f"(SELECT count(*) FROM ({pick.format(a)} INTERSECT {pick.format(b)}) x) AS {a}_{b}_overlap"


@query(
    "split_entity_overlap",
    f"SELECT {_overlap('train', 'validation')}, {_overlap('train', 'test')}, {_overlap('validation', 'test')}",
)
def split_entity_overlap(d):
    return splits.split_entity_overlap(splits.join_split_map(d.missed_rows, d.split_map))


@query(
    "union_all",
    """SELECT snapshot_id, missed_upcoming_emi AS label, target_name FROM ov_missed
    UNION ALL SELECT snapshot_id, future_dpd30, target_name FROM ov_dpd30""",
)
def union_all(d):
    return audit.union_all(
        [
            d.missed.select("snapshot_id", F.col("missed_upcoming_emi").alias("label"), "target_name"),
            d.dpd30.select("snapshot_id", F.col("future_dpd30").alias("label"), "target_name"),
        ]
    )


@query(
    "dedupe_entity",
    """SELECT SK_ID_CURR, DAYS_DECISION, SK_ID_PREV, NAME_YIELD_GROUP FROM
    (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_DECISION, SK_ID_PREV) AS r FROM fx_previous) x WHERE r = 1""",
)
def dedupe_entity(d):
    rows = d("fx_previous").select("SK_ID_CURR", "DAYS_DECISION", "SK_ID_PREV", "NAME_YIELD_GROUP")
    return entity.dedupe_entity(rows, order_by=["DAYS_DECISION", "SK_ID_PREV"])


@query("distinct_days", "SELECT snapshot_day FROM ov_days")
def distinct_days(d):
    return splits.distinct_days(d.missed_rows)


@query("distinct_groups", "SELECT DISTINCT slice_col, slice_val FROM ov_long WHERE slice_val IS NOT NULL")
def distinct_groups(d):
    return slice_counts(d("fx_pred"), SLICE_COLS).select("slice_col", "slice_val").distinct()
