"""Tests of how much a query does: models fitted, columns read, rows a task holds."""

import pytest
from dueday.operators import models, prepare, skew, timeline
from dueday.plans import stages
from dueday.session import materialize
from pyspark.sql import functions as F


@pytest.mark.parametrize("asked, fitted", [("rf", ["rf"]), ("rounds", ["gb"])])
def test_only_the_model_asked_for_is_fitted(spark, monkeypatch, asked, fitted):
    done = []
    monkeypatch.setattr(models, "train_rf", lambda *a, **b: done.append("rf"))
    monkeypatch.setattr(models, "train_gb", lambda *a, **b: done.append("gb") or (None, None))
    monkeypatch.setattr(prepare, "fit_preprocessor", lambda *a: None)
    monkeypatch.setattr(stages, "column_roles", lambda rows: {"numeric": [], "categorical": []})
    found = stages.train_target(spark.createDataFrame([("train",)], "split string"))
    found.prepared = found.rows
    assert done == []
    getattr(found, asked)
    assert done == fitted


def test_few_codes_need_no_join(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("new",)], "c string")
    codes = spark.createDataFrame([("c", "a", 0), ("c", "b", 1)], "column_name string, category string, code int")
    found = prepare.encode(rows, codes, {"c": "x"}, {"c": 2}, ["c"])
    assert {(r.c, r.x) for r in found.collect()} == {("a", 0), ("b", 1), (None, -1), ("new", -1)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_median_of_values_in_one_bucket(spark):
    df = spark.createDataFrame([(1e9 + 1, float("nan")), (1e9 + 2, float("nan")), (1e9 + 4, 1.0), (-1e-9, None)], "a double, b double")
    found = {r.column_name: r.median for r in prepare.exact_medians(df, ["a", "b"]).collect()}
    assert found["a"] == 1e9 + 1.5 and found["b"] != found["b"]


def test_rows_a_task_of_the_timeline_holds(spark, monkeypatch):
    from frames import EVENT_SCHEMA, random_events

    events = spark.createDataFrame(random_events(3, borrowers=40), EVENT_SCHEMA)
    few = sorted(map(str, timeline.borrower_timeline(events).collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 20)
    many = timeline.borrower_timeline(events)
    assert many.rdd.getNumPartitions() == -(-events.count() // 20) > 16
    assert sorted(map(str, many.collect())) == few


def test_rows_a_task_of_the_payments_holds(spark, sf_dir, monkeypatch):
    from dueday.sources.fixtures import Tables

    few = Tables(spark, sf_dir)("fx_installments")
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    many = Tables(spark, sf_dir)("fx_installments")
    parts = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 100)
    assert many.rdd.getNumPartitions() == parts
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_loans_of_many_payments_are_not_broadcast(spark, sf_dir, monkeypatch):
    from dueday.sources.fixtures import Tables

    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    plan = Tables(spark, sf_dir)("fx_installments")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rows_a_task_of_the_interval_window_holds(spark, monkeypatch):
    from dueday.operators.assemble import interval_exists

    rows = spark.createDataFrame([(i, i % 40, i % 7) for i in range(300)] + [(300, None, 1), (301, 1, None)], "snapshot_id int, SK_ID_CURR int, snapshot_day int")
    flagged = spark.createDataFrame([(k, 4) for k in range(0, 40, 3)] * 2, "SK_ID_CURR int, snapshot_day int")
    few = sorted(map(str, interval_exists(rows, flagged, 2).collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 5)
    many = interval_exists(rows, flagged, 2)
    assert sorted(map(str, many.collect())) == few
    parts = -(-(rows.count() + flagged.count()) // 5)
    assert f"hashpartitioning(SK_ID_CURR#{''}" in many._jdf.queryExecution().executedPlan().toString() and f", {parts})" in many._jdf.queryExecution().executedPlan().toString()


def test_features_are_one_array_made_into_a_vector(spark):
    codes = spark.createDataFrame([("c", "a", 0), ("c", "b", 1)], "column_name string, category string, code int")
    pre = prepare.Preprocessor(["n", "m"], ["c"], {"n": 2.5, "m": None}, {"c": "b"}, {"c": 2}, codes)
    rows = spark.createDataFrame([(1, 4.0, None, "a"), (2, None, 0.0, None), (3, 0.0, 7.0, "new")], "id int, n double, m double, c string")
    found = pre.transform(rows, ["id"])
    assert {r.id: r.features.toArray().tolist() for r in found.collect()} == {1: [4.0, 0.0, 0.0], 2: [2.5, 0.0, 1.0], 3: [0.0, 7.0, -1.0]}
    assert "struct(" not in found._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="NaN"):
        pre.transform(spark.createDataFrame([(1, float("nan"), 1.0, "a")], rows.schema), ["id"]).collect()


def test_features_of_many_columns_are_filled_by_one_function(spark):
    """An expression a column makes a method longer than the 8,000 bytes the JVM compiles."""
    names = [f"n{i}" for i in range(60)]
    pre = prepare.Preprocessor(names, ["c"], dict.fromkeys(names, 0.5), {"c": "a"}, {"c": 1}, spark.createDataFrame([("c", "a", 0)], "column_name string, category string, code int"))
    rows = spark.range(3).select("id", F.lit("a").alias("c"), *[F.when(F.col("id") != i % 3, F.col("id") + i).alias(n) for i, n in enumerate(names)])
    found = pre.transform(materialize(rows, "wide"), ["id"])
    want = {k: [0.5 if k == i % 3 else float(k + i) for i in range(60)] + [0.0] for k in range(3)}
    assert {r.id: r.features.toArray().tolist() for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1 and plan.count("coalesce(n") == 0
    sizes = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(found._jdf.queryExecution().executedPlan())
    assert all(sizes.apply(k)._3().maxMethodCodeSize() <= 8000 for k in range(sizes.size()))


def test_the_array_of_features_is_built_by_compiled_code(spark):
    names = ["n", "m"]
    pre = prepare.Preprocessor(names, ["c"], {"n": 0.5, "m": float("nan")}, {"c": "a"}, {"c": 1}, spark.createDataFrame([("c", "a", 0)], "column_name string, category string, code int"))
    rows = spark.createDataFrame([(1, None, 2.0, "a"), (2, None, None, "a")], "id int, n double, m double, c string")
    found = pre.transform(materialize(rows, "narrow"), ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    built = next(line for line in plan.splitlines() if "array(n#" in line)
    assert "*(" in built and "zip_with(" not in built
    assert found.where("id = 1").first().features.toArray().tolist() == [0.5, 2.0, 0.0]
    with pytest.raises(Exception, match="NaN"):  # a median that is NaN fails the rows it would fill
        found.collect()
