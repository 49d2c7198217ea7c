"""Per-borrower feature families. Every aggregate combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import APPLICATION_NUMERIC, CREDIT, ENTITY, FEATURE_FAMILIES, SLICE_COLS
from .skew import HOT_ROWS, lookup


def dedupe_entity(df: DataFrame, key: str = ENTITY, order_by: list[str] | None = None) -> DataFrame:
    """One row per key: the first in ``order_by`` (all other columns by default).

    A minimum over structs keeps one candidate per key and task before the
    shuffle, so many copies of one key never meet in a sort.
    """
    rest = [c for c in df.columns if c != key]
    first = [*(order_by or []), *[c for c in rest if c not in (order_by or [])]]
    # NULLs last, as a stable order over present values first
    ranked = F.struct(*[x for c in first for x in (F.col(c).isNull().alias(f"{c}_absent"), F.col(c))])
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ranked).alias("kept"))
    return kept.select(*[F.col(key) if c == key else F.col("kept")[c].alias(c) for c in df.columns])


def fill_category(df: DataFrame, columns: list[str] = SLICE_COLS) -> DataFrame:
    return df.fillna("missing", subset=columns)


def application_features(app: DataFrame) -> DataFrame:
    """Projection of the cleaned application table, one row per borrower."""
    return dedupe_entity(fill_category(app.select(ENTITY, *APPLICATION_NUMERIC, *SLICE_COLS)))


def previous_app_features(prev: DataFrame) -> DataFrame:
    grouped = (
        prev.where(F.col(ENTITY).isNotNull())
        .groupBy(ENTITY)
        .agg(
            F.count("SK_ID_PREV").alias("prev_application_count"),
            F.sum(S.is_value("status_group", "approved")).alias("prev_approved_count"),
            F.sum(S.is_value("status_group", "rejected")).alias("prev_rejected_count"),
            F.sum(S.is_value("status_group", "active")).alias("prev_active_count"),
            F.avg("AMT_CREDIT").alias("prev_credit_mean"),
            F.max("AMT_CREDIT").alias("prev_credit_max"),
            F.avg("AMT_ANNUITY").alias("prev_annuity_mean"),
            F.avg("AMT_DOWN_PAYMENT").alias("prev_down_payment_mean"),
            F.max("DAYS_DECISION").alias("prev_days_decision_max"),
            F.min("DAYS_DECISION").alias("prev_days_decision_min"),
        )
    )
    return grouped.withColumn(
        "prev_approval_rate", S.safe_ratio("prev_approved_count", "prev_application_count")
    )


def bureau_balance_agg(balance: DataFrame) -> DataFrame:
    """Balance months reduced to one row per credit, before any join."""
    dpd = S.is_one_of("status_group", S.DPD_GROUPS)
    dpd30 = S.is_one_of("status_group", S.DPD30_GROUPS)
    return (
        balance.where(F.col(CREDIT).isNotNull())
        .groupBy(CREDIT)
        .agg(
            F.count("MONTHS_BALANCE").alias("bb_record_count"),
            F.max(dpd).alias("bb_any_dpd"),
            F.max(dpd30).alias("bb_any_dpd30"),
            F.sum(dpd).alias("bb_dpd_month_count"),
        )
    )


def join_preagg(bureau: DataFrame, balance_agg: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Credits with their balance aggregate; a much-repeated or missing credit id is spread."""
    others = [c for c in bureau.columns if c != CREDIT]
    return lookup(bureau, balance_agg, CREDIT, others, limit=limit)


def bureau_features(bureau: DataFrame, balance: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    merged = join_preagg(bureau, bureau_balance_agg(balance), limit)
    return (
        merged.where(F.col(ENTITY).isNotNull())
        .groupBy(ENTITY)
        .agg(
            F.count(CREDIT).alias("bureau_record_count"),
            F.sum(S.is_value("CREDIT_ACTIVE", "Active")).alias("bureau_active_count"),
            F.sum(S.positive("CREDIT_DAY_OVERDUE")).alias("bureau_overdue_count"),
            F.avg("AMT_CREDIT_SUM").alias("bureau_credit_sum_mean"),
            F.avg("AMT_CREDIT_SUM_DEBT").alias("bureau_credit_sum_debt_mean"),
            F.avg("AMT_CREDIT_MAX_OVERDUE").alias("bureau_max_overdue_mean"),
            F.max("DAYS_CREDIT").alias("bureau_days_credit_max"),
            F.min("DAYS_CREDIT").alias("bureau_days_credit_min"),
            F.max("bb_any_dpd").alias("bureau_bb_any_dpd"),
            F.max("bb_any_dpd30").alias("bureau_bb_any_dpd30"),
            F.coalesce(F.sum("bb_dpd_month_count"), F.lit(0)).alias("bureau_bb_dpd_month_count"),
        )
    )


def entity_features(application: DataFrame, previous: DataFrame, bureau: DataFrame) -> DataFrame:
    """The three families side by side, one row per borrower.

    All three have unique keys, so they meet before the big snapshot side is
    touched; snapshots then need one join instead of three.
    """
    return application.join(previous, ENTITY, "full").join(bureau, ENTITY, "full")


def feature_dictionary(spark) -> DataFrame:
    """(feature, family, source) as declared by the builders."""
    rows = [
        (feature, family, source)
        for family, (features, source) in FEATURE_FAMILIES.items()
        for feature in features
    ]
    return spark.createDataFrame(rows, "feature_name string, feature_family string, source_table string")
