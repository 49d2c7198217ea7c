"""Audit tables and per-key aggregates."""

from pyspark.sql import functions as F

from ..operators import audit, entity, labels, metrics, splits
from ..operators.assemble import target_rows
from ..operators.clean import payment_flags
from ..plans.stages import TARGETS
from ..schemas import APPLICATION_NUMERIC, AUDIT_KEYS
from ..session import materialize
from ..sources.fixtures import RAW_VIEWS
from .base import SINGLE, query

# Column counts of the cleaned tables, which is what the audit describes.
CLEAN_COLUMNS = {
    "application_train": 23, "installments_payments": 12, "POS_CASH_balance": 10,
    "previous_application": 11, "bureau": 11, "bureau_balance": 4,
}


def _cleaned(d):
    return {
        "application_train": d.application,
        "installments_payments": payment_flags(d.raw["installments_payments"]),
        "POS_CASH_balance": d.pos,
        "previous_application": d.previous,
        "bureau": d.raw["bureau"],
        "bureau_balance": d.balance,
    }


def _audit_sql(table):
    view, keys = RAW_VIEWS[table], AUDIT_KEYS[table]
    k = ", ".join(keys)
    absent = " OR ".join(f"{c} IS NULL" for c in keys)
    return (
        f"SELECT '{table}' AS table_name, count(*) AS row_count, CAST({CLEAN_COLUMNS[table]} AS INT) AS column_count, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {view}) q) AS duplicate_key_count, "
        f"'{'|'.join(keys)}' AS primary_key, count(*) FILTER ({absent}) AS key_missing_count FROM {view}"
    )


@query("audit_summary", " UNION ALL ".join(_audit_sql(t) for t in RAW_VIEWS))
def audit_summary(d):
    return audit.audit_summary(_cleaned(d))


@query(
    "duplicate_summary",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{'|'.join(k)}' AS duplicate_check, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(k)} FROM {RAW_VIEWS[t]}) q) AS duplicate_count FROM {RAW_VIEWS[t]}"
        for t, k in AUDIT_KEYS.items()
    ),
)
def duplicate_summary(d):
    return audit.duplicate_summary(d.raw)


def _missing_sql(table, view):
    return (
        f"SELECT '{table}' AS table_name, column_name, missing_count, missing_count / n AS missing_pct "
        f"FROM (SELECT count(*) AS n FROM {view}) t, "
        f"(UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM {view}) ON COLUMNS(*) INTO NAME column_name VALUE missing_count) u"
    )


CLEAN_VIEWS = {
    "application_train": "ov_application",
    "installments_payments": "ov_payments",
    "POS_CASH_balance": "fx_pos",
    "previous_application": "ov_previous",
    "bureau": "fx_bureau",
    "bureau_balance": "ov_balance",
}


@query(
    "missing_summary",
    " UNION ALL ".join(_missing_sql(t, v) for t, v in CLEAN_VIEWS.items()),
    missing_pct=6,
)
def missing_summary(d):
    tables = _cleaned(d) | {"POS_CASH_balance": d.raw["POS_CASH_balance"]}
    rows = [audit.missing_summary(tables[t], t) for t in CLEAN_VIEWS]
    return audit.sorted_missing(audit.union_all(rows)).drop("present_count")


PROFILE = [*APPLICATION_NUMERIC, "DAYS_EMPLOYED"]


@query(
    "numeric_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean FROM ov_application"
        for c in PROFILE
    ),
    min=3, max=3, mean=3,
)
def numeric_profile(d):
    return audit.numeric_profile(d.application, PROFILE)


@query(
    "anomaly_counts",
    """SELECT 'application_train' AS table_name, 'employment_placeholder' AS check_name, count(*) AS value FROM fx_application WHERE DAYS_EMPLOYED = 365243
    UNION ALL SELECT 'POS_CASH_balance', 'broken_sequences', count(*) FROM (SELECT SK_ID_PREV FROM fx_pos GROUP BY 1 HAVING count(MONTHS_BALANCE) <> count(DISTINCT MONTHS_BALANCE)) x
    UNION ALL SELECT 'bureau_balance', 'linked_key_count', count(*) FROM (SELECT SK_ID_BUREAU FROM fx_bureau INTERSECT SELECT SK_ID_BUREAU FROM fx_bureau_balance) a
    UNION ALL SELECT 'bureau_balance', 'unmatched_key_count', count(*) FROM (SELECT SK_ID_BUREAU FROM fx_bureau_balance EXCEPT SELECT SK_ID_BUREAU FROM fx_bureau) b""",
)
def anomaly_counts(d):
    return audit.anomaly_counts(d.raw)


SEQUENCES = {"POS_CASH_balance": ("fx_pos", "SK_ID_PREV"), "bureau_balance": ("fx_bureau_balance", "SK_ID_BUREAU")}


@query(
    "sequence_integrity",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {key} AS id, count(MONTHS_BALANCE) AS position_count, count(DISTINCT MONTHS_BALANCE) AS distinct_count "
        f"FROM {view} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(MONTHS_BALANCE) <> count(DISTINCT MONTHS_BALANCE)"
        for t, (view, key) in SEQUENCES.items()
    ),
)
def sequence_integrity(d):
    found = [
        audit.sequence_integrity(d.raw[t], key).select(
            F.lit(t).alias("table_name"), F.col(key).alias("id"), "position_count", "distinct_count"
        )
        for t, (_, key) in SEQUENCES.items()
    ]
    return audit.union_all(found)


@query("collapse_events", "SELECT * FROM ov_events", AMT_INSTALMENT=4, total_amount_paid=4)
def collapse_events(d):
    return d.events


@query("application_features", "SELECT * FROM ov_app_features", AMT_INCOME_TOTAL=4, AMT_CREDIT=4, AMT_ANNUITY=5, AMT_GOODS_PRICE=4,
       AGE_YEARS=2, EMPLOYMENT_YEARS=2, CREDIT_TO_INCOME_RATIO=6, ANNUITY_TO_INCOME_RATIO=6, GOODS_TO_CREDIT_RATIO=6,
       EXT_SOURCE_1=6, EXT_SOURCE_2=6, EXT_SOURCE_3=6)
def application_features(d):
    return d.application_features


@query("previous_app_features", "SELECT * FROM ov_prev_features", prev_credit_mean=SINGLE, prev_credit_max=4, prev_annuity_mean=SINGLE,
       prev_down_payment_mean=SINGLE, prev_approval_rate=6)
def previous_app_features(d):
    return d.previous_features


@query("bureau_balance_agg", "SELECT * FROM ov_bb")
def bureau_balance_agg(d):
    return entity.bureau_balance_agg(d.balance)


@query("bureau_features", "SELECT * FROM ov_bureau_features", bureau_credit_sum_mean=SINGLE, bureau_credit_sum_debt_mean=SINGLE, bureau_max_overdue_mean=SINGLE)
def bureau_features(d):
    return d.bureau_features


def _model_sql(target):
    kept = f"SELECT * EXCLUDE (missed_upcoming_emi, future_dpd30), {target} AS label FROM ov_model WHERE {target} IS NOT NULL"
    return _missing_sql(f"model_table_{target}", f"({kept})")


@query(
    "feature_quality",
    " UNION ALL ".join([_missing_sql("snapshot_feature_base", "ov_base"), *map(_model_sql, TARGETS)]),
    missing_pct=6,
)
def feature_quality(d):
    """The feature base and the model table of each target; the joined rows are written once for all three."""
    model = materialize(d.model, "model")
    tables = {"snapshot_feature_base": model.drop(*TARGETS)}
    tables |= {f"model_table_{t}": target_rows(model, t) for t in TARGETS}
    # the type names of the two engines differ, so they are left out here
    return audit.feature_quality(tables).drop("dtype", "present_count")


@query(
    "target_summary",
    """SELECT 'missed_upcoming_emi' AS target_name, count(*) AS row_count, sum(missed_upcoming_emi)::BIGINT AS positive_count, avg(missed_upcoming_emi) AS positive_rate FROM ov_missed
    UNION ALL SELECT 'future_dpd30', count(*), sum(future_dpd30)::BIGINT, avg(future_dpd30) FROM ov_dpd30""",
    positive_rate=6,
)
def target_summary(d):
    return labels.target_summary(labels.both_labels(d.snapshots, d.pos, d.window_days, d.hot))


@query("label_value_counts", "SELECT missed_upcoming_emi AS label, count(*) AS row_count FROM ov_missed GROUP BY 1")
def label_value_counts(d):
    return labels.label_value_counts(d.missed, "missed_upcoming_emi")


@query(
    "split_summary",
    """SELECT split, count(*) AS row_count, sum(label)::BIGINT AS positive_count, count(DISTINCT SK_ID_CURR) AS borrower_count,
    min(snapshot_day) AS snapshot_day_min, max(snapshot_day) AS snapshot_day_max, avg(label) AS positive_rate FROM ov_missed_split GROUP BY 1""",
    positive_rate=6,
)
def split_summary(d):
    return splits.split_summary(splits.join_split_map(d.missed_rows, d.split_map))


BALANCE_SQL = """SELECT model, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives,
 count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0) AS pos_weight FROM fx_pred GROUP BY 1"""


@query("class_balance", BALANCE_SQL, pos_weight=6)
def class_balance(d):
    return metrics.class_balance(d("fx_pred"), ["model"])


@query(
    "class_weights",
    f"SELECT *, (negatives + positives) / (2 * negatives) AS weight_negative, (negatives + positives) / (2 * positives) AS weight_positive FROM ({BALANCE_SQL}) b",
    pos_weight=6, weight_negative=6, weight_positive=6,
)
def class_weights(d):
    return metrics.class_weights(d("fx_pred"), ["model"])
