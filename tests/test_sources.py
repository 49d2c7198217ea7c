"""Scans and sinks."""

import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dueday.operators import reports, timeline
from dueday.operators.skew import hot_keys
from dueday.schemas import EVENT_ORDER
from dueday.session import scratch_path
from dueday.sources import sinks, tables
from frames import EVENT_SCHEMA, event


def local(path):
    return path.removeprefix("file:")


def test_csv_columns_are_found_by_name(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("x", -1, 7, None), ("y", 0, 8, "5")], "OTHER string, MONTHS_BALANCE int, SK_ID_BUREAU bigint, STATUS string")
    df.write.option("header", True).csv(path)
    got = tables.scan_csv_projected(spark, path, "bureau_balance")
    assert got.dtypes == [("SK_ID_BUREAU", "bigint"), ("MONTHS_BALANCE", "int"), ("STATUS", "string")]
    assert sorted(map(tuple, got.collect())) == [(7, -1, None), (8, 0, "5")]


def test_csv_without_a_needed_column(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(1,)], "SK_ID_BUREAU bigint").write.option("header", True).csv(path)
    with pytest.raises(tables.MissingInputError, match="MONTHS_BALANCE"):
        tables.scan_csv_projected(spark, path, "bureau_balance")


def test_missing_inputs_are_all_named(spark, sf_dir):
    with pytest.raises(tables.MissingInputError) as err:
        tables.require_inputs(spark, {f"{sf_dir}/orders.parquet": ["o_orderkey", "nope"], f"{sf_dir}/none.parquet": []})
    assert "nope" in str(err.value) and "none.parquet" in str(err.value)


def test_scan_prunes_and_pushes_down(spark, sf_dir):
    df = tables.scan_parquet_pruned(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey"], "l_linenumber = 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linenumber,3)" in plan and "l_extendedprice" not in plan


def test_rerun_replaces_metric_rows(spark):
    path = scratch_path(spark, "metrics")
    schema = "target string, model string, f1 double"
    sinks.sink_metrics_append(spark.createDataFrame([("t", "rf", 0.1), ("t", "gb", 0.2)], schema), path)
    got = sinks.sink_metrics_append(spark.createDataFrame([("t", "rf", 0.9)], schema), path)
    assert sorted((r.model, r.f1) for r in got.collect()) == [("gb", 0.2), ("rf", 0.9)]


def test_split_filter_prunes_partitions(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "test")], "a int, split string")
    got = sinks.sink_by_split(df, scratch_path(spark, "split")).where("split = 'test'")
    assert sorted(r.a for r in got.collect()) == [2, 3]
    assert len(got.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().executedPlan().toString()


def test_family_cache(spark):
    path, built = scratch_path(spark, "family"), []

    def build():
        built.append(1)
        return spark.range(3)

    for version, rebuild in (("a", False), ("a", False), ("a", True), ("b", False)):
        assert sinks.family_cache(spark, path, version, build, rebuild).count() == 3
    assert len(built) == 3


def test_report_is_one_file(spark):
    path = scratch_path(spark, "report")
    sinks.sink_csv_report(spark.range(10).repartition(4), path)
    assert len(glob.glob(local(path) + "/part-*.csv")) == 1


def test_event_layout_spreads_a_hot_borrower(spark, many_parts):
    rows = [event(1, k, 1, -k) for k in range(400)] + [event(b, 1000 + b, 1, -5) for b in range(2, 40)]
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    path = scratch_path(spark, "layout")
    laid = sinks.event_layout(events, path, buckets=4, hot=hot_keys(events, "SK_ID_CURR", 100))
    assert sorted(map(tuple, laid.collect())) == sorted(map(tuple, events.collect()))
    files = [pq.read_table(f) for f in glob.glob(local(path) + "/part-*.parquet")]
    holds = [t for t in files if 1 in t.column("SK_ID_CURR").to_pylist()]
    assert len(holds) > 1 and len(files) <= 4 * 2 + 4
    for t in files:
        keys = list(zip(*[t.column(c).to_pylist() for c in ("SK_ID_CURR", *EVENT_ORDER)]))
        assert keys == sorted(keys)


def test_history_over_the_layout_needs_no_shuffle_of_events(spark):
    events = spark.createDataFrame([event(b, 100 * b + k, k, -90 + k) for b in range(50) for k in range(9)], EVENT_SCHEMA)
    hot = hot_keys(events, "SK_ID_CURR")
    laid = sinks.event_layout(events, scratch_path(spark, "layout"), buckets=4, hot=hot)
    got = timeline.installment_history(laid, hot)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, timeline.installment_history(events, hot).collect()))


def test_sorted_output_is_in_order(spark):
    """Rows inside each written file, and a mixed order over all rows."""
    rows = spark.range(500).select((F.col("id") * 37 % 11).alias("SK_ID_CURR"), (F.col("id") * 91 % 101).alias("snapshot_day"), "id")
    path = scratch_path(spark, "sorted")
    sinks.sort_outputs(rows.repartition(3)).write.parquet(path)
    files = [pq.read_table(f).to_pylist() for f in glob.glob(local(path) + "/part-*.parquet")]
    for rows_of in files:
        keys = [(r["SK_ID_CURR"], r["snapshot_day"]) for r in rows_of]
        assert keys == sorted(keys)
    got = [(r.SK_ID_CURR, r.id) for r in reports.sort_mixed(rows.repartition(5), F.desc("SK_ID_CURR"), F.asc("id")).collect()]
    assert got == sorted(got, key=lambda t: (-t[0], t[1])) and len(got) == 500


def test_column_roles(spark):
    df = spark.createDataFrame([], "SK_ID_CURR bigint, a double, b int, c string, label int, split string")
    assert tables.column_roles(df) == {
        "numeric": ["a", "b"], "categorical": ["c"], "passthrough": ["SK_ID_CURR", "label", "split"]}


def test_manifest(spark):
    path = scratch_path(spark, "run")
    got = sinks.run_manifest(spark, "s", {"x": spark.range(4), "none": spark.range(0)}, {"k": 1}, path).orderBy("output").collect()
    assert [tuple(r) for r in got] == [("s", "none", 0, 1, '{"k": 1}'), ("s", "x", 4, 1, '{"k": 1}')]
    (file,) = glob.glob(local(path) + "/manifest/part-*.json")
    assert [json.loads(line)["row_count"] for line in open(file)] == [4, 0] and spark.read.parquet(f"{path}/x").count() == 4


def test_large_report_is_written_whole(spark, tmp_path):
    path = str(tmp_path / "large")
    back = sinks.sink_csv_report(spark.range(200_000).repartition(3), path)
    assert back.count() == 200_000 and back.agg({"id": "sum"}).first()[0] == 199_999 * 100_000


def test_events_come_in_order(spark, many_parts):
    rows = [(k % 7, k * 37 % 101, k) for k in range(500)]
    got = sinks.sort_events(spark.createDataFrame(rows, "a long, b long, c long"), ["a", "b", "c"]).collect()
    assert [tuple(r) for r in got] == sorted(rows)
