"""Projections, scalar rules and filters."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean, labels, metrics, prepare, reports, splits, timeline
from ..operators.assemble import tag_and_rename, threshold_lookup
from ..operators.entity import fill_category
from ..schemas import SLICE_COLS
from .base import query

RATIOS = {"CREDIT_TO_INCOME_RATIO": 6, "ANNUITY_TO_INCOME_RATIO": 6, "GOODS_TO_CREDIT_RATIO": 6}


@query("sentinel_to_null", "SELECT SK_ID_CURR, DAYS_EMPLOYED, DAYS_EMPLOYED_ANOMALY_FLAG FROM ov_application")
def sentinel_to_null(d):
    return d("fx_application").select(
        "SK_ID_CURR",
        S.sentinel_to_null("DAYS_EMPLOYED").alias("DAYS_EMPLOYED"),
        S.flag(F.col("DAYS_EMPLOYED") == S.EMPLOYED_PLACEHOLDER).alias("DAYS_EMPLOYED_ANOMALY_FLAG"),
    )


@query("offset_to_years", "SELECT SK_ID_CURR, AGE_YEARS, EMPLOYMENT_YEARS FROM ov_application", AGE_YEARS=2, EMPLOYMENT_YEARS=2)
def offset_to_years(d):
    return d.application.select("SK_ID_CURR", "AGE_YEARS", "EMPLOYMENT_YEARS")


@query("safe_ratio", f"SELECT SK_ID_CURR, {', '.join(RATIOS)} FROM ov_application", **RATIOS)
def safe_ratio(d):
    return d.application.select("SK_ID_CURR", *RATIOS)


@query("clean_application", "SELECT * FROM ov_application", EXT_SOURCE_1=9, EXT_SOURCE_2=9, EXT_SOURCE_3=9,
       AMT_CREDIT=4, AMT_INCOME_TOTAL=4, AMT_ANNUITY=5, AMT_GOODS_PRICE=4, AGE_YEARS=2, EMPLOYMENT_YEARS=2, **RATIOS)
def clean_application(d):
    return d.application


@query("payment_flags", "SELECT * FROM ov_payments", AMT_PAYMENT=4)
def payment_flags(d):
    return clean.payment_flags(d("fx_installments"))


@query(
    "pos_dpd_flags",
    "SELECT *, CAST(coalesce(SK_DPD, 0) > 0 AS INT) AS HAS_DPD_FLAG, CAST(coalesce(SK_DPD_DEF, 0) > 0 AS INT) AS HAS_DPD_DEF_FLAG FROM fx_pos",
)
def pos_dpd_flags(d):
    return d.pos


@query("previous_status_group", "SELECT SK_ID_PREV, NAME_CONTRACT_STATUS, status_group FROM ov_previous")
def previous_status_group(d):
    return d.previous.select("SK_ID_PREV", "NAME_CONTRACT_STATUS", "status_group")


@query("bureau_status_group", "SELECT SK_ID_BUREAU, MONTHS_BALANCE, STATUS, status_group FROM ov_balance")
def bureau_status_group(d):
    return d.balance


PREVIOUS_INDICATORS = {"is_approved": "approved", "is_rejected": "rejected", "is_active_prev": "active"}
BALANCE_INDICATORS = {"is_dpd": S.DPD_GROUPS, "is_dpd30": S.DPD30_GROUPS}


def _indicator_sql(source, view, key, month, name, condition):
    return (
        f"SELECT '{source}' AS source, {key} AS id, {month} AS month, '{name}' AS indicator, "
        f"CAST(coalesce({condition}, false) AS INT) AS value FROM {view}"
    )


def _one_of(values):
    return "status_group IN (" + ", ".join(f"'{v}'" for v in values) + ")"


INDICATOR_SQL = [
    *[
        _indicator_sql("previous_application", "ov_previous", "SK_ID_PREV", "CAST(NULL AS INT)", c, f"status_group = '{v}'")
        for c, v in PREVIOUS_INDICATORS.items()
    ],
    _indicator_sql("bureau", "fx_bureau", "SK_ID_BUREAU", "CAST(NULL AS INT)", "is_active", "CREDIT_ACTIVE = 'Active'"),
    _indicator_sql("bureau", "fx_bureau", "SK_ID_BUREAU", "CAST(NULL AS INT)", "is_overdue", "CREDIT_DAY_OVERDUE > 0"),
    *[
        _indicator_sql("bureau_balance", "ov_balance", "SK_ID_BUREAU", "MONTHS_BALANCE", c, _one_of(v))
        for c, v in BALANCE_INDICATORS.items()
    ],
]


@query("indicator_columns", " UNION ALL ".join(INDICATOR_SQL))
def indicator_columns(d):
    """The 0/1 columns of all three tables, one row per row and indicator."""

    def long(df, source, key, month, flags):
        rows = df.select(F.lit(source).alias("source"), F.col(key).alias("id"), month.cast("int").alias("month"),
                         *[col.alias(name) for name, col in flags.items()])
        return rows.unpivot(["source", "id", "month"], list(flags), "indicator", "value")

    none = F.lit(None)
    previous = {c: S.is_value("status_group", v) for c, v in PREVIOUS_INDICATORS.items()}
    credit = {"is_active": S.is_value("CREDIT_ACTIVE", "Active"), "is_overdue": S.positive("CREDIT_DAY_OVERDUE")}
    months = {c: S.is_one_of("status_group", v) for c, v in BALANCE_INDICATORS.items()}
    return (
        long(d.previous, "previous_application", "SK_ID_PREV", none, previous)
        .unionByName(long(d.raw["bureau"], "bureau", "SK_ID_BUREAU", none, credit))
        .unionByName(long(d.balance, "bureau_balance", "SK_ID_BUREAU", F.col("MONTHS_BALANCE"), months))
    )


BEHAVIOUR = "SK_ID_PREV, SK_ID_CURR, NUM_INSTALMENT_NUMBER, is_late, is_missed, is_partial, is_on_time, payment_ratio, delay_nonnull"


@query("behaviour_flags", f"SELECT {BEHAVIOUR} FROM ov_behaviour", payment_ratio=6)
def behaviour_flags(d):
    return timeline.behaviour_flags(d.events).select(*BEHAVIOUR.split(", "))


@query(
    "snapshot_keys",
    "SELECT snapshot_id, SK_ID_CURR, SK_ID_PREV, borrower_event_order, snapshot_day, snapshot_month_approx FROM ov_snap",
)
def snapshot_keys(d):
    return d.snapshots.select(
        "snapshot_id", "SK_ID_CURR", "SK_ID_PREV", "borrower_event_order", "snapshot_day", "snapshot_month_approx"
    )


@query("month_to_day", "SELECT SK_ID_PREV, MONTHS_BALANCE, MONTHS_BALANCE * 30 AS approx_day FROM fx_pos")
def month_to_day(d):
    return d("fx_pos").select("SK_ID_PREV", "MONTHS_BALANCE", S.day_of_month("MONTHS_BALANCE").alias("approx_day"))


@query(
    "dpd30_flags",
    """SELECT 'installments' AS source, SK_ID_CURR, DAYS_INSTALMENT AS day, CAST(coalesce(aggregated_payment_delay_days, -999999) >= 30 AS INT) AS flag FROM ov_events
    UNION ALL SELECT 'pos', SK_ID_CURR, MONTHS_BALANCE * 30, CAST(coalesce(SK_DPD, 0) >= 30 OR coalesce(SK_DPD_DEF, 0) >= 30 AS INT) FROM fx_pos""",
)
def dpd30_flags(d):
    inst = d.events.select(
        F.lit("installments").alias("source"), "SK_ID_CURR", F.col("DAYS_INSTALMENT").alias("day"),
        S.instalment_dpd30("aggregated_payment_delay_days").alias("flag"),
    )
    pos = d("fx_pos").select(
        F.lit("pos").alias("source"), "SK_ID_CURR", S.day_of_month("MONTHS_BALANCE").alias("day"),
        S.pos_dpd30("SK_DPD", "SK_DPD_DEF").alias("flag"),
    )
    return inst.unionByName(pos)


@query(
    "fill_category",
    f"SELECT SK_ID_CURR, {', '.join(f"coalesce({c}, 'missing') AS {c}" for c in SLICE_COLS)} FROM fx_application",
)
def fill_category_(d):
    return fill_category(d("fx_application").select("SK_ID_CURR", *SLICE_COLS))


@query("apply_threshold", "SELECT model, SK_ID_CURR, ord, y_prob, y_pred_05, y_pred_optimal FROM fx_pred")
def apply_threshold(d):
    return threshold_lookup(d("fx_pred"), d("fx_threshold")).select(
        "model", "SK_ID_CURR", "ord", "y_prob",
        S.apply_threshold("y_prob", 0.5).alias("y_pred_05"),
        S.apply_threshold("y_prob", F.col("threshold")).alias("y_pred_optimal"),
    )


@query("tag_and_rename", "SELECT snapshot_id, missed_upcoming_emi AS label, 'missed_upcoming_emi' AS target_name FROM ov_missed")
def tag_and_rename_(d):
    return tag_and_rename(d.missed.select("snapshot_id", "missed_upcoming_emi"), "missed_upcoming_emi", "missed_upcoming_emi")


@query("strip_prefix", "SELECT SK_ID_CURR, CASE WHEN SK_ID_CURR % 2 = 0 THEN CODE_GENDER ELSE concat(NAME_INCOME_TYPE, '__', CODE_GENDER) END AS name FROM fx_application")
def strip_prefix(d):
    raw = F.when(F.col("SK_ID_CURR") % 2 == 0, F.concat(F.lit("cat__"), "CODE_GENDER")).otherwise(
        F.concat_ws("__", F.lit("cat"), "NAME_INCOME_TYPE", "CODE_GENDER")
    )
    named = d("fx_application").select("SK_ID_CURR", raw.alias("name"))
    return prepare.strip_feature_prefix(named, "name")


@query(
    "report_rounding",
    "SELECT SK_ID_CURR, round_even(EXT_SOURCE_1, 4) AS EXT_SOURCE_1, round_even(EXT_SOURCE_2, 4) AS EXT_SOURCE_2 FROM fx_application",
    EXT_SOURCE_1=4, EXT_SOURCE_2=4,
)
def report_rounding(d):
    return reports.report_rounding(d("fx_application").select("SK_ID_CURR", "EXT_SOURCE_1", "EXT_SOURCE_2"))


# --- filters, limits, samples ---------------------------------------------


@query("filter_has_next", "SELECT snapshot_id, next_DAYS_INSTALMENT FROM ov_snap WHERE next_DAYS_INSTALMENT IS NOT NULL")
def filter_has_next(d):
    return labels.filter_has_next(d.snapshots).select("snapshot_id", "next_DAYS_INSTALMENT")


@query(
    "filter_complete_window",
    "SELECT snapshot_id, snapshot_day, borrower_max_installment_day FROM ov_hits WHERE future_window_complete_flag = 1",
)
def filter_complete_window(d):
    return labels.filter_complete_window(d.snapshots).select(
        "snapshot_id", "snapshot_day", "borrower_max_installment_day"
    )


@query(
    "limit_entities",
    "SELECT snapshot_id, future_dpd30 FROM ov_dpd30 WHERE SK_ID_CURR IN (SELECT DISTINCT SK_ID_CURR FROM ov_snap ORDER BY 1 LIMIT 100)",
)
def limit_entities(d):
    return labels.future_dpd30(d.snapshots, d.pos, limit_borrowers=100, hot=d.hot).select("snapshot_id", "future_dpd30")


@query(
    "min_group_filter",
    "SELECT target, model, slice_col, slice_val, n, pos FROM ov_cells WHERE n >= 3000 AND pos >= 400 AND pos < n",
)
def min_group_filter(d):
    groups = metrics.slice_counts(d("fx_pred"), SLICE_COLS)
    return metrics.min_group_filter(groups, 3000, 400).select("target", "model", "slice_col", "slice_val", "n", "pos")


@query(
    "sample_rows",
    """SELECT snapshot_id, snapshot_day, missed_upcoming_emi AS label FROM (
        SELECT *, row_number() OVER (ORDER BY md5(snapshot_id || ':42'), snapshot_id) AS r FROM ov_missed WHERE missed_upcoming_emi IS NOT NULL) x WHERE r <= 100""",
)
def sample_rows(d):
    rows = d.missed.select("snapshot_id", "snapshot_day", F.col("missed_upcoming_emi").alias("label"))
    return prepare.sample_rows(rows, 100)


@query(
    "report_filters",
    "SELECT model, SK_ID_CURR, ord, split, CODE_GENDER, NAME_INCOME_TYPE FROM ov_pred WHERE split = 'test' AND CODE_GENDER IN ('F', 'M') AND NAME_INCOME_TYPE = 'BUILDING'",
)
def report_filters(d):
    rows = splits.join_split_map(d("fx_pred"), d.split_map)
    return rows.where(
        (F.col("split") == "test") & F.col("CODE_GENDER").isin("F", "M") & (F.col("NAME_INCOME_TYPE") == "BUILDING")
    ).select("model", "SK_ID_CURR", "ord", "split", "CODE_GENDER", "NAME_INCOME_TYPE")
