"""Raw table schemas and the column groups the operators share."""

from __future__ import annotations

ENTITY = "SK_ID_CURR"
CREDIT = "SK_ID_BUREAU"
INSTALMENT_KEYS = ["SK_ID_PREV", "SK_ID_CURR", "NUM_INSTALMENT_VERSION", "NUM_INSTALMENT_NUMBER"]

# SK_ID_PREV comes last so that events which tie on the business order still
# have one defined order on any cluster layout.
EVENT_ORDER = ["DAYS_INSTALMENT", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION", "SK_ID_PREV"]

SNAPSHOT_KEYS = [
    "snapshot_id",
    "SK_ID_CURR",
    "SK_ID_PREV",
    "borrower_event_order",
    "snapshot_day",
    "snapshot_month_approx",
]

# The category columns that results are sliced by, and the feature lists of the output contract.
SLICE_COLS = [
    "CODE_GENDER",
    "NAME_INCOME_TYPE",
    "NAME_EDUCATION_TYPE",
    "NAME_FAMILY_STATUS",
    "NAME_HOUSING_TYPE",
    "OCCUPATION_TYPE",
]
# Occupation is an error-analysis slice only.
FAIRNESS_COLS = SLICE_COLS[:5]

APPLICATION_NUMERIC = [
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "AMT_GOODS_PRICE",
    "AGE_YEARS",
    "EMPLOYMENT_YEARS",
    "DAYS_EMPLOYED_ANOMALY_FLAG",
    "CREDIT_TO_INCOME_RATIO",
    "ANNUITY_TO_INCOME_RATIO",
    "GOODS_TO_CREDIT_RATIO",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
]
PREVIOUS_FEATURES = [
    "prev_application_count",
    "prev_approved_count",
    "prev_rejected_count",
    "prev_active_count",
    "prev_credit_mean",
    "prev_credit_max",
    "prev_annuity_mean",
    "prev_down_payment_mean",
    "prev_days_decision_max",
    "prev_days_decision_min",
    "prev_approval_rate",
]
BUREAU_FEATURES = [
    "bureau_record_count",
    "bureau_active_count",
    "bureau_overdue_count",
    "bureau_credit_sum_mean",
    "bureau_credit_sum_debt_mean",
    "bureau_max_overdue_mean",
    "bureau_days_credit_max",
    "bureau_days_credit_min",
    "bureau_bb_any_dpd",
    "bureau_bb_any_dpd30",
    "bureau_bb_dpd_month_count",
]
HISTORY_FEATURES = [
    "hist_total_installments",
    "hist_late_count",
    "hist_missed_count",
    "hist_partial_count",
    "hist_on_time_count",
    "hist_delay_mean",
    "hist_delay_max",
    "hist_recent_delay",
    "hist_recent_payment_ratio",
    "hist_delay_mean_last_3",
    "hist_delay_mean_last_6",
    "hist_late_count_last_3",
    "hist_late_count_last_6",
    "hist_on_time_streak",
    "hist_late_streak",
]
# Family name and source table of each feature, as listed in the
# feature dictionary.
FEATURE_FAMILIES = {
    "application": (APPLICATION_NUMERIC + SLICE_COLS, "cleaned_application_train.parquet"),
    "previous_application": (PREVIOUS_FEATURES, "cleaned_previous_application.parquet"),
    "bureau": (BUREAU_FEATURES, "cleaned_bureau.parquet|cleaned_bureau_balance.parquet"),
    "installment_history": (HISTORY_FEATURES, "cleaned_installment_events.parquet"),
}


# Raw columns and types of the input contract, as DDL strings that ``spark.read.schema`` takes.
RAW_SCHEMAS: dict[str, str] = {
    "application_train": (
        "SK_ID_CURR bigint, TARGET int, CODE_GENDER string, NAME_INCOME_TYPE string,"
        "NAME_EDUCATION_TYPE string, NAME_FAMILY_STATUS string, NAME_HOUSING_TYPE string,"
        "OCCUPATION_TYPE string, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double,"
        "AMT_GOODS_PRICE double, DAYS_BIRTH int, DAYS_EMPLOYED int, EXT_SOURCE_1 double,"
        "EXT_SOURCE_2 double, EXT_SOURCE_3 double"
    ),
    "installments_payments": (
        "SK_ID_PREV bigint, SK_ID_CURR bigint, NUM_INSTALMENT_VERSION int, NUM_INSTALMENT_NUMBER int,"
        "DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT int, AMT_INSTALMENT double, AMT_PAYMENT double"
    ),
    "POS_CASH_balance": (
        "SK_ID_PREV bigint, SK_ID_CURR bigint, MONTHS_BALANCE int, CNT_INSTALMENT int,"
        "CNT_INSTALMENT_FUTURE int, NAME_CONTRACT_STATUS string, SK_DPD int, SK_DPD_DEF int"
    ),
    "previous_application": (
        "SK_ID_PREV bigint, SK_ID_CURR bigint, NAME_CONTRACT_TYPE string, NAME_CONTRACT_STATUS string,"
        "AMT_ANNUITY double, AMT_APPLICATION double, AMT_CREDIT double, AMT_DOWN_PAYMENT double,"
        "DAYS_DECISION int, NAME_YIELD_GROUP string"
    ),
    "bureau": (
        "SK_ID_CURR bigint, SK_ID_BUREAU bigint, CREDIT_ACTIVE string, CREDIT_CURRENCY string,"
        "DAYS_CREDIT int, DAYS_CREDIT_ENDDATE int, DAYS_ENDDATE_FACT int, CREDIT_DAY_OVERDUE int,"
        "AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_MAX_OVERDUE double"
    ),
    "bureau_balance": "SK_ID_BUREAU bigint, MONTHS_BALANCE int, STATUS string",
}

# The key each raw table is audited on.
AUDIT_KEYS: dict[str, list[str]] = {
    "application_train": ["SK_ID_CURR"],
    "installments_payments": INSTALMENT_KEYS,
    "POS_CASH_balance": ["SK_ID_PREV", "MONTHS_BALANCE"],
    "previous_application": ["SK_ID_PREV", "SK_ID_CURR"],
    "bureau": ["SK_ID_BUREAU"],
    "bureau_balance": ["SK_ID_BUREAU", "MONTHS_BALANCE"],
}
