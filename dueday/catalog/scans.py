"""Scans, sources and sinks. Sinks are checked by reading back what they wrote."""

from pyspark.sql import functions as F

from ..operators import entity
from ..operators.audit import missing_summary
from ..operators.metrics import MODEL_KEYS
from ..operators.splits import join_split_map
from ..operators.assemble import FEATURES
from ..schemas import FEATURE_FAMILIES, SNAPSHOT_KEYS
from ..sources import sinks, tables
from .base import query

APP_COLS = ["SK_ID_CURR", "CODE_GENDER", "OCCUPATION_TYPE", "AMT_CREDIT", "DAYS_BIRTH", "DAYS_EMPLOYED", "EXT_SOURCE_1"]


@query("scan_csv_projected", f"SELECT {', '.join(APP_COLS)} FROM fx_application", EXT_SOURCE_1=9)
def scan_csv_projected(d):
    path = d.scratch("application-csv")
    extra = d("fx_application").withColumn("NOT_NEEDED", F.lit("x"))
    extra.write.option("header", True).csv(path)
    return tables.scan_csv_projected(d.spark, path, "application_train", columns=APP_COLS)


@query(
    "scan_parquet_pruned",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_linenumber >= 3 AND l_quantity > 10",
)
def scan_parquet_pruned(d):
    cols = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return tables.scan_parquet_pruned(
        d.spark, f"{d.sf_dir}/lineitem.parquet", cols, "l_linenumber >= 3 AND l_quantity > 10"
    )


@query(
    "require_inputs",
    "SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'orders', count(*) FROM orders "
    "UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
)
def require_inputs(d):
    needed = {"customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey"]}
    tables.require_inputs(d.spark, {f"{d.sf_dir}/{t}.parquet": cols for t, cols in needed.items()})
    counts = [d(t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in needed]
    return counts[0].union(counts[1]).union(counts[2])


def _label_metrics(d):
    """A metric table with one row per (target, model)."""
    return d("fx_pred").groupBy(*MODEL_KEYS).agg(
        F.count("*").alias("row_count"), F.sum("label").alias("positive_count"), F.avg("y_prob").alias("mean_prob")
    )


LABEL_METRICS = (
    "SELECT target, model, count(*) AS row_count, sum(label)::BIGINT AS positive_count, avg(y_prob) AS mean_prob FROM fx_pred GROUP BY 1, 2"
)


@query("scan_metric_tables", LABEL_METRICS, mean_prob=6)
def scan_metric_tables(d):
    written = _label_metrics(d)
    path = d.scratch("metrics-csv")
    sinks.sink_csv_report(written, path)
    schema = "target string, model string, row_count bigint, positive_count bigint, mean_prob double"
    return tables.scan_metric_tables(d.spark, {"m": path}, {"m": schema})["m"]


@query(
    "column_roles",
    """SELECT c.column_name, CASE WHEN c.column_name IN ('snapshot_id', 'SK_ID_CURR', 'SK_ID_PREV', 'borrower_event_order', 'snapshot_day', 'snapshot_month_approx') THEN 'passthrough'
     WHEN c.column_name IN ('CODE_GENDER', 'NAME_INCOME_TYPE', 'NAME_EDUCATION_TYPE', 'NAME_FAMILY_STATUS', 'NAME_HOUSING_TYPE', 'OCCUPATION_TYPE') THEN 'categorical' ELSE 'numeric' END AS role,
     n - missing AS present_count
    FROM (SELECT count(*) AS n FROM ov_base) t, (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM ov_base) ON COLUMNS(*) INTO NAME column_name VALUE missing) c""",
)
def column_roles(d):
    base = d.model.select(*SNAPSHOT_KEYS, *FEATURES)
    present = missing_summary(base, "model").select("column_name", "present_count")
    return tables.column_role_table(base).join(present, "column_name")


EVENT_COLS = "SK_ID_PREV, SK_ID_CURR, NUM_INSTALMENT_NUMBER, DAYS_INSTALMENT, first_payment_day, AMT_INSTALMENT, missing_payment_flag"


@query("sink_parquet", f"SELECT {EVENT_COLS} FROM ov_events")
def sink_parquet(d):
    out = d.events.select(*EVENT_COLS.split(", "))
    return sinks.sink_parquet(out, d.scratch("events"), sort_within=["SK_ID_CURR", "DAYS_INSTALMENT"])


@query("sink_csv_report", LABEL_METRICS, mean_prob=6)
def sink_csv_report(d):
    return sinks.sink_csv_report(_label_metrics(d), d.scratch("report"))


@query("sink_metrics_append", LABEL_METRICS, mean_prob=6)
def sink_metrics_append(d):
    path = d.scratch("metrics")
    rows = _label_metrics(d)
    sinks.sink_metrics_append(rows.where("model = 'rf'"), path)
    sinks.sink_metrics_append(rows.where("model = 'gb'"), path)
    again = sinks.sink_metrics_append(rows.where("model = 'rf'"), path)
    return again.select("target", "model", "row_count", "positive_count", "mean_prob")


@query("sink_by_split", "SELECT snapshot_id, snapshot_day, label, split FROM ov_missed_split WHERE split = 'validation'")
def sink_by_split(d):
    rows = d.missed_rows.select("snapshot_id", "snapshot_day", "label")
    written = sinks.sink_by_split(join_split_map(rows, d.split_map), d.scratch("by-split"))
    return written.where("split = 'validation'").select("snapshot_id", "snapshot_day", "label", "split")


@query(
    "run_manifest",
    """SELECT 'labels' AS stage, 'missed_upcoming_emi' AS output, count(*) AS row_count, 22 AS column_count, '{"window_days": 90}' AS params FROM ov_missed
    UNION ALL SELECT 'labels', 'future_dpd30', count(*), 13, '{"window_days": 90}' FROM ov_dpd30""",
)
def run_manifest(d):
    outputs = {"missed_upcoming_emi": d.missed, "future_dpd30": d.dpd30}
    return sinks.run_manifest(d.spark, "labels", outputs, {"window_days": 90}, d.scratch("run"))


@query(
    "family_cache",
    "SELECT SK_ID_CURR, prev_application_count, prev_approved_count, prev_days_decision_max FROM ov_prev_features",
)
def family_cache(d):
    path = d.scratch("family")
    cols = ["SK_ID_CURR", "prev_application_count", "prev_approved_count", "prev_days_decision_max"]
    sinks.family_cache(d.spark, path, "v1", lambda: d.previous_features.select(*cols))

    def must_not_run():
        raise AssertionError("the family was built already")

    return sinks.family_cache(d.spark, path, "v1", must_not_run)


@query("event_layout", f"SELECT {EVENT_COLS}, NUM_INSTALMENT_VERSION FROM ov_events")
def event_layout(d):
    out = d.events.select(*EVENT_COLS.split(", "), "NUM_INSTALMENT_VERSION")
    return sinks.event_layout(out, d.scratch("layout"), hot=d.hot)


@query(
    "feature_dictionary",
    """SELECT column_name AS feature_name, CASE WHEN column_name LIKE 'hist_%' THEN 'installment_history' WHEN column_name LIKE 'prev_%' THEN 'previous_application'
     WHEN column_name LIKE 'bureau_%' THEN 'bureau' ELSE 'application' END AS feature_family,
     CASE WHEN column_name LIKE 'hist_%' THEN 'cleaned_installment_events.parquet' WHEN column_name LIKE 'prev_%' THEN 'cleaned_previous_application.parquet'
     WHEN column_name LIKE 'bureau_%' THEN 'cleaned_bureau.parquet|cleaned_bureau_balance.parquet' ELSE 'cleaned_application_train.parquet' END AS source_table, missing_count
    FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(* EXCLUDE (snapshot_id, SK_ID_CURR, SK_ID_PREV, borrower_event_order, snapshot_day, snapshot_month_approx))) FROM ov_base)
     ON COLUMNS(*) INTO NAME column_name VALUE missing_count) u""",
)
def feature_dictionary(d):
    features = [f for cols, _ in FEATURE_FAMILIES.values() for f in cols]
    quality = missing_summary(d.model.select(*features), "model").select(
        F.col("column_name").alias("feature_name"), "missing_count"
    )
    return entity.feature_dictionary(d.spark).join(quality, "feature_name")

