"""Cleaning: raw tables in, cleaned tables out, one projection or one grouping each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import INSTALMENT_KEYS


def clean_application(app: DataFrame) -> DataFrame:
    """Sentinel day count to NULL with a flag, ages in years, guarded ratios."""
    employed = S.sentinel_to_null("DAYS_EMPLOYED")
    return app.withColumns(
        {
            "DAYS_EMPLOYED": employed,
            "DAYS_EMPLOYED_ANOMALY_FLAG": S.flag(F.col("DAYS_EMPLOYED") == S.EMPLOYED_PLACEHOLDER),
            "AGE_YEARS": S.offset_to_years("DAYS_BIRTH"),
            "EMPLOYMENT_YEARS": S.offset_to_years(employed),
            "CREDIT_TO_INCOME_RATIO": S.safe_ratio("AMT_CREDIT", "AMT_INCOME_TOTAL"),
            "ANNUITY_TO_INCOME_RATIO": S.safe_ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
            "GOODS_TO_CREDIT_RATIO": S.safe_ratio("AMT_GOODS_PRICE", "AMT_CREDIT"),
        }
    )


def payment_flags(payments: DataFrame) -> DataFrame:
    """Delay and missing / partial / late flags per payment row."""
    delay = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return payments.withColumns(
        {
            "payment_delay_days": delay,
            "missing_payment_flag": S.missing_payment("DAYS_ENTRY_PAYMENT", "AMT_PAYMENT"),
            "partial_payment_flag": S.partial_payment("AMT_PAYMENT", "AMT_INSTALMENT"),
            "late_payment_flag": S.positive(delay),
        }
    )


def collapse_events(payments: DataFrame) -> DataFrame:
    """Repeated payments of one instalment become one event.

    Every aggregate combines before the shuffle, so a much-repeated instalment
    sends one row per task.
    """
    flagged = payments if "payment_delay_days" in payments.columns else payment_flags(payments)
    events = flagged.groupBy(*INSTALMENT_KEYS).agg(
        F.min("DAYS_INSTALMENT").alias("DAYS_INSTALMENT"),
        F.min("DAYS_ENTRY_PAYMENT").alias("first_payment_day"),
        F.max("DAYS_ENTRY_PAYMENT").alias("last_payment_day"),
        F.max("AMT_INSTALMENT").alias("AMT_INSTALMENT"),
        S.or_zero(F.sum("AMT_PAYMENT")).alias("total_amount_paid"),
        F.count(F.lit(1)).alias("row_count"),
        F.max("missing_payment_flag").alias("missing_payment_flag"),
        F.max("partial_payment_flag").alias("partial_payment_flag"),
        F.max("late_payment_flag").alias("late_payment_flag"),
        F.max("payment_delay_days").alias("max_payment_delay_days"),
    )
    return events.withColumns(
        {
            "aggregated_payment_delay_days": F.col("first_payment_day") - F.col("DAYS_INSTALMENT"),
            "underpaid_after_aggregation_flag": S.underpaid("total_amount_paid", "AMT_INSTALMENT"),
        }
    )


def pos_dpd_flags(pos: DataFrame) -> DataFrame:
    return pos.withColumns(
        {"HAS_DPD_FLAG": S.positive("SK_DPD"), "HAS_DPD_DEF_FLAG": S.positive("SK_DPD_DEF")}
    )


def clean_previous(prev: DataFrame) -> DataFrame:
    return prev.withColumn("status_group", S.previous_status_group("NAME_CONTRACT_STATUS"))


def clean_bureau_balance(balance: DataFrame) -> DataFrame:
    return balance.withColumn("status_group", S.bureau_status_group("STATUS"))
