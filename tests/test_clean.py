"""Cleaning, entity features, audits, splits: rules that small frames pin down."""

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from dueday.functions import scalars as S
from dueday.operators import assemble, audit, clean, entity, splits
from frames import PAYMENT_SCHEMA


def test_unpaid_instalment(spark):
    rows = [(1, 1, 1, 1, -30, None, 100.0, None), (1, 1, 1, 1, -30, None, 100.0, None)]
    got = clean.collapse_events(spark.createDataFrame(rows, PAYMENT_SCHEMA)).first()
    assert (got.total_amount_paid, got.row_count, got.missing_payment_flag) == (0.0, 2, 1)
    assert got.aggregated_payment_delay_days is None and got.underpaid_after_aggregation_flag == 1


def test_repeated_payments_become_one_event(spark):
    rows = [(1, 1, 1, 1, -30, -35, 100.0, 60.0), (1, 1, 1, 1, -30, -20, 100.0, 40.0), (1, 1, 1, 2, 0, 0, 9.0, 9.0)]
    got = clean.collapse_events(spark.createDataFrame(rows, PAYMENT_SCHEMA)).where("NUM_INSTALMENT_NUMBER = 1").first()
    assert (got.first_payment_day, got.last_payment_day, got.total_amount_paid) == (-35, -20, 100.0)
    assert (got.aggregated_payment_delay_days, got.max_payment_delay_days) == (-5, 10)
    assert (got.partial_payment_flag, got.late_payment_flag, got.underpaid_after_aggregation_flag) == (1, 1, 0)


def test_null_key_parts_form_a_group(spark):
    rows = [(None, 1, 1, 1, -30, -30, 1.0, 1.0), (None, 1, 1, 1, -30, -29, 1.0, 1.0)]
    assert clean.collapse_events(spark.createDataFrame(rows, PAYMENT_SCHEMA)).count() == 1


def test_ratio_and_sentinel(spark):
    df = spark.createDataFrame([(10.0, 0.0, 365243), (10.0, 4.0, -100), (None, 4.0, None)], "a double, b double, d int")
    got = df.select(S.safe_ratio("a", "b").alias("r"), S.sentinel_to_null("d").alias("d")).collect()
    assert [tuple(r) for r in got] == [(None, None), (2.5, -100), (None, None)]


@pytest.mark.parametrize(
    "status, group", [("Approved", "approved"), ("Refused", "rejected"), ("Unused offer", "unused_offer"), ("??", "other"), (None, "missing")]
)
def test_previous_status(spark, status, group):
    df = spark.createDataFrame([(status,)], "s string")
    assert df.select(S.previous_status_group("s")).first()[0] == group


def test_bureau_status_without_code_is_other(spark):
    df = spark.createDataFrame([(None,), ("Z",), ("5",)], "s string")
    assert [r[0] for r in df.select(S.bureau_status_group("s")).collect()] == ["other", "other", "dpd_120_plus"]


def test_borrower_without_balance_rows(spark):
    bureau = spark.createDataFrame(
        [(1, 10, "Active", 0, 5.0, None, None, -9)],
        "SK_ID_CURR bigint, SK_ID_BUREAU bigint, CREDIT_ACTIVE string, CREDIT_DAY_OVERDUE int, AMT_CREDIT_SUM double,"
        "AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_MAX_OVERDUE double, DAYS_CREDIT int",
    )
    balance = spark.createDataFrame([], "SK_ID_BUREAU bigint, MONTHS_BALANCE int, STATUS string")
    got = entity.bureau_features(bureau, clean.clean_bureau_balance(balance)).first()
    assert got.bureau_bb_dpd_month_count == 0 and got.bureau_bb_any_dpd is None


def test_dedupe_keeps_the_first_row(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "c"), (1, 2, "a"), (2, None, "z"), (2, 7, None)], "k int, o int, v string")
    got = {r.k: (r.o, r.v) for r in entity.dedupe_entity(df, "k", ["o"]).collect()}
    assert got == {1: (2, "a"), 2: (7, None)}


def test_cardinality_contract(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert assemble.assert_cardinality(df, ["a", "b"]) is df
    with pytest.raises(assemble.CardinalityError, match="repeats"):
        assemble.assert_cardinality(df, ["a"])


def test_missing_summary_and_profile(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0), (None, None)], "a int, b double")
    got = {r.column_name: (r.missing_count, round(r.missing_pct, 3), r.dtype) for r in audit.missing_summary(df, "t", True).collect()}
    assert got == {"a": (1, 0.333, "int"), "b": (2, 0.667, "double")}
    assert {r.column_name: (r.min, r.max, r.mean) for r in audit.numeric_profile(df).collect()} == {
        "a": (1.0, 2.0, 1.5), "b": (4.0, 4.0, 4.0)}


def test_audit_counts_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (None, None)], "a int, b int")
    got = audit.audit_summary({"t": df}, {"t": ["a", "b"]}).first()
    assert (got.row_count, got.duplicate_key_count, got.key_missing_count, got.primary_key) == (4, 1, 2, "a|b")


def test_empty_table_is_audited(spark):
    df = spark.createDataFrame([], "a int")
    assert audit.audit_summary({"t": df}, {"t": ["a"]}).first().row_count == 0


def days(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("snapshot_day"))


@pytest.mark.parametrize("n", [3, 4, 10, 90, 170, 180])
def test_split_positions(spark, n):
    import math

    got = [r.split for r in splits.chronological_split(days(spark, n)).orderBy("snapshot_day").collect()]
    t = min(max(math.floor(n * 0.70), 1), n - 2)
    v = min(max(math.floor(n * (0.70 + 0.15)), t + 1), n - 1)
    assert got == ["train"] * t + ["validation"] * (v - t) + ["test"] * (n - v)


def test_two_days_cannot_be_split(spark):
    with pytest.raises(SparkRuntimeException, match="3 distinct days"):
        splits.chronological_split(days(spark, 2)).collect()


def test_day_outside_the_map_fails(spark):
    split_map = splits.chronological_split(days(spark, 5))
    with pytest.raises(SparkRuntimeException, match="outside the split map"):
        splits.join_split_map(days(spark, 6), split_map).collect()


def test_overlap(spark):
    rows = [(1, "train"), (1, "test"), (2, "train"), (2, "validation"), (2, "test"), (3, "test")]
    got = splits.split_entity_overlap(spark.createDataFrame(rows, "SK_ID_CURR int, split string")).first()
    assert tuple(got) == (1, 2, 1)
