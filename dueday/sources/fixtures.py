"""Raw-shaped credit tables derived from the driver's test tables.

Each view is one SQL text that Spark and DuckDB both accept; only the day
difference is spelled differently, at ``{DD}``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import apply_threshold
from ..operators.assemble import threshold_lookup
from ..operators.clean import collapse_events
from ..operators.labels import filter_has_next, missed_flag
from ..operators.skew import HotKeys, hot_keys, lookup, many_rows, small_tasks
from ..operators.timeline import build_snapshots
from ..schemas import ENTITY, SLICE_COLS
from ..session import materialize

SPARK_DD = "datediff(CAST(o_orderdate AS DATE), DATE '2002-06-01')"
DUCK_DD = "date_diff('day', DATE '2002-06-01', CAST(o_orderdate AS DATE))"

BASE_TABLES = ["customer", "orders", "lineitem"]

VIEWS: dict[str, str] = {
    "fx_installments": """
SELECT p AS SK_ID_PREV, b AS SK_ID_CURR, 1 AS NUM_INSTALMENT_VERSION, k AS NUM_INSTALMENT_NUMBER, due AS DAYS_INSTALMENT,
 CASE WHEN h = 50 THEN NULL WHEN h < 90 THEN due - h % 15 WHEN h < 97 THEN due + h - 89 ELSE due + h - 62 END AS DAYS_ENTRY_PAYMENT,
 a AS AMT_INSTALMENT, CASE WHEN h = 50 THEN NULL WHEN h % 25 = 3 THEN a * 0.5E0 ELSE a END AS AMT_PAYMENT
FROM (SELECT l_orderkey AS p, o_custkey AS b, l_linenumber AS k, l_extendedprice AS a,
   CAST({DD} AS INT) + 30 * l_linenumber AS due,
   CAST((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7 + l_orderkey) % 100 AS INT) AS h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t""",
    "fx_pos": """
SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR, CAST(floor({DD} / 30.0E0) AS INT) + m AS MONTHS_BALANCE,
 12 AS CNT_INSTALMENT, 12 - m AS CNT_INSTALMENT_FUTURE, CASE WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'Active' END AS NAME_CONTRACT_STATUS,
 CASE WHEN (o_orderkey * 7 + m) % 101 = 0 THEN 45 WHEN (o_orderkey + m) % 53 = 0 THEN NULL ELSE CAST((o_orderkey + m) % 4 AS INT) END AS SK_DPD,
 CASE WHEN (o_orderkey * 3 + m) % 211 = 0 THEN 31 ELSE 0 END AS SK_DPD_DEF
FROM orders CROSS JOIN (SELECT 0 AS m UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) x""",
    "fx_application": """
SELECT c_custkey AS SK_ID_CURR, CAST(c_custkey % 12 = 0 AS INT) AS TARGET,
 CASE WHEN c_custkey % 50 = 0 THEN 'XNA' WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END AS CODE_GENDER, c_mktsegment AS NAME_INCOME_TYPE,
 CASE WHEN c_nationkey = 0 THEN 'EDU_RARE' ELSE concat('EDU_', CAST(c_nationkey % 4 AS STRING)) END AS NAME_EDUCATION_TYPE,
 concat('FAM_', CAST(c_custkey % 5 AS STRING)) AS NAME_FAMILY_STATUS, concat('HOUSE_', CAST(c_custkey % 7 AS STRING)) AS NAME_HOUSING_TYPE,
 CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE concat('OCC_', CAST(c_custkey % 11 AS STRING)) END AS OCCUPATION_TYPE,
 CASE WHEN c_custkey % 40 = 0 THEN 0E0 ELSE abs(c_acctbal) * 12 END AS AMT_INCOME_TOTAL, abs(c_acctbal) * 25 + 1000 AS AMT_CREDIT,
 CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE (abs(c_acctbal) * 25 + 1000) / 20 END AS AMT_ANNUITY,
 CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE (abs(c_acctbal) * 25 + 1000) * 0.9E0 END AS AMT_GOODS_PRICE,
 CAST(-(7000 + (c_custkey * 13) % 18000) AS INT) AS DAYS_BIRTH,
 CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE CAST(-((c_custkey * 7) % 9000) AS INT) END AS DAYS_EMPLOYED,
 CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE (c_custkey % 97) / 97E0 END AS EXT_SOURCE_1, (c_custkey % 89) / 89E0 AS EXT_SOURCE_2,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 83) / 83E0 END AS EXT_SOURCE_3
FROM customer""",
    "fx_previous": """
SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR, CASE WHEN o_orderkey % 2 = 0 THEN 'Cash loans' ELSE 'Consumer loans' END AS NAME_CONTRACT_TYPE,
 CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN 'Other state' WHEN o_orderkey % 19 = 0 THEN 'Canceled' WHEN o_orderkey % 23 = 0 THEN 'Unused offer'
  WHEN o_orderstatus = 'F' THEN 'Approved' WHEN o_orderstatus = 'P' THEN 'Refused' ELSE 'Active' END AS NAME_CONTRACT_STATUS,
 o_totalprice / 12 AS AMT_ANNUITY, o_totalprice AS AMT_APPLICATION, o_totalprice * 0.9E0 AS AMT_CREDIT,
 CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_totalprice * 0.1E0 END AS AMT_DOWN_PAYMENT, CAST({DD} AS INT) AS DAYS_DECISION, o_orderpriority AS NAME_YIELD_GROUP
FROM orders""",
    "fx_bureau": """
SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU, CASE WHEN o_orderstatus = 'O' THEN 'Active' ELSE 'Closed' END AS CREDIT_ACTIVE, 'currency 1' AS CREDIT_CURRENCY,
 CAST({DD} AS INT) AS DAYS_CREDIT, CAST({DD} AS INT) + 365 AS DAYS_CREDIT_ENDDATE, CASE WHEN o_orderstatus = 'F' THEN CAST({DD} AS INT) + 300 END AS DAYS_ENDDATE_FACT,
 CASE WHEN o_orderkey % 61 = 0 THEN 12 ELSE 0 END AS CREDIT_DAY_OVERDUE, o_totalprice AS AMT_CREDIT_SUM,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice * 0.4E0 END AS AMT_CREDIT_SUM_DEBT, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 0.01E0 END AS AMT_CREDIT_MAX_OVERDUE
FROM orders WHERE o_orderkey % 10 <> 9""",
    "fx_bureau_balance": """
SELECT l_orderkey AS SK_ID_BUREAU, -l_linenumber AS MONTHS_BALANCE,
 CASE WHEN h < 60 THEN '0' WHEN h < 66 THEN '1' WHEN h < 68 THEN '2' WHEN h < 69 THEN '3' WHEN h < 70 THEN '4' WHEN h < 71 THEN '5' WHEN h < 88 THEN 'C' WHEN h < 99 THEN 'X' ELSE NULL END AS STATUS
FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 11 + l_suppkey * 5 + l_orderkey) % 100 AS h FROM lineitem) t WHERE l_orderkey % 4 <> 0""",
    "fx_events": """
SELECT *, first_payment_day - DAYS_INSTALMENT AS aggregated_payment_delay_days, CASE WHEN total_amount_paid + 1E-9 < AMT_INSTALMENT THEN 1 ELSE 0 END AS underpaid_after_aggregation_flag
FROM (SELECT SK_ID_PREV, SK_ID_CURR, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER, min(DAYS_INSTALMENT) AS DAYS_INSTALMENT, min(DAYS_ENTRY_PAYMENT) AS first_payment_day, max(AMT_INSTALMENT) AS AMT_INSTALMENT,
  coalesce(sum(AMT_PAYMENT), 0E0) AS total_amount_paid, count(*) AS row_count, max(CASE WHEN DAYS_ENTRY_PAYMENT IS NULL OR AMT_PAYMENT IS NULL OR AMT_PAYMENT <= 0 THEN 1 ELSE 0 END) AS missing_payment_flag
 FROM fx_installments GROUP BY 1,2,3,4) e""",
    "fx_snap": """
SELECT * FROM (SELECT SK_ID_CURR, CAST(row_number() OVER w - 1 AS INT) AS ord, DAYS_INSTALMENT AS snapshot_day, lead(missing_payment_flag) OVER w AS nm, lead(underpaid_after_aggregation_flag) OVER w AS nu,
  lead(aggregated_payment_delay_days) OVER w AS nd, lead(DAYS_INSTALMENT) OVER w AS ndue FROM fx_events
  WINDOW w AS (PARTITION BY SK_ID_CURR ORDER BY DAYS_INSTALMENT, NUM_INSTALMENT_NUMBER, NUM_INSTALMENT_VERSION, SK_ID_PREV)) s WHERE ndue IS NOT NULL""",
    "fx_scored": """
SELECT s.SK_ID_CURR, s.ord, s.snapshot_day, s.label, m.model, CASE WHEN m.model = 'rf' THEN ((s.SK_ID_CURR * 37 + s.ord * 11) % 61 + 39 * s.label) / 100E0 ELSE ((s.SK_ID_CURR * 17 + s.ord * 29) % 71 + 25 * s.label) / 100E0 END AS y_prob
FROM (SELECT *, CASE WHEN nm > 0 OR nu > 0 OR coalesce(nd, -999999) > 0 THEN 1 ELSE 0 END AS label FROM fx_snap) s CROSS JOIN (SELECT 'rf' AS model UNION ALL SELECT 'gb') m""",
    # Scored rows with target tag, split-free slice columns and the tuned-threshold
    # prediction; the threshold table is fixed here so both engines agree on it.
    "fx_threshold": """
SELECT 'missed_upcoming_emi' AS target, 'rf' AS model, 0.55E0 AS optimal_threshold UNION ALL SELECT 'missed_upcoming_emi', 'gb', 0.45E0""",
    "fx_pred": """
SELECT 'missed_upcoming_emi' AS target, s.model, s.SK_ID_CURR, s.ord, s.snapshot_day, s.label, s.y_prob,
 a.CODE_GENDER, a.NAME_INCOME_TYPE, a.NAME_EDUCATION_TYPE, a.NAME_FAMILY_STATUS, a.NAME_HOUSING_TYPE, a.OCCUPATION_TYPE,
 CASE WHEN s.y_prob >= 0.5E0 THEN 1 ELSE 0 END AS y_pred_05, CASE WHEN s.y_prob >= CASE WHEN s.model = 'rf' THEN 0.55E0 ELSE 0.45E0 END THEN 1 ELSE 0 END AS y_pred_optimal
FROM fx_scored s LEFT JOIN fx_application a ON s.SK_ID_CURR = a.SK_ID_CURR""",
}

# Raw table names over the raw-shaped views.
RAW_VIEWS = {
    "application_train": "fx_application",
    "installments_payments": "fx_installments",
    "POS_CASH_balance": "fx_pos",
    "previous_application": "fx_previous",
    "bureau": "fx_bureau",
    "bureau_balance": "fx_bureau_balance",
}

_NAME = re.compile(r"\b(fx_\w+|" + "|".join(BASE_TABLES) + r")\b")


class Tables:
    """``Tables(spark, sf_dir)("orders")`` reads a test table, ``("fx_pos")`` a view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._seen: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self._view(name) if name in VIEWS else self._parquet(name)
        return self._seen[name]

    def _parquet(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        # Views that Spark builds with the package's own operators: the texts
        # above would put a hot borrower into one window task, or join by pairs.
        own = {
            "fx_pos": self._pos,
            "fx_events": self._events,
            "fx_snap": self._snap,
            "fx_scored": self._scored,
            "fx_pred": self._pred,
        }
        if name in own:
            return own[name]()
        return self._sql(VIEWS[name])

    def _pos(self) -> DataFrame:
        months = "FROM orders CROSS JOIN (SELECT 0 AS m UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) x"
        return self._sql(VIEWS["fx_pos"].replace(months, "FROM orders LATERAL VIEW explode(array(0, 1, 2, 3)) x AS m"))

    def _events(self) -> DataFrame:
        return collapse_events(self("fx_installments"))

    @cached_property
    def hot(self) -> HotKeys:
        """Hot borrowers, counted on the raw payments: a bound on their events."""
        return hot_keys(self("fx_installments"), ENTITY)

    def _snap(self) -> DataFrame:
        rows = filter_has_next(build_snapshots(self("fx_events"), self.hot)).select(
            "snapshot_id",
            ENTITY,
            F.col("borrower_event_order").alias("ord"),
            "snapshot_day",
            missed_flag().alias("label"),
        )
        return materialize(rows, "labels")

    def _scored(self) -> DataFrame:
        return self._with_scores(self("fx_snap").drop("snapshot_id"))

    def _with_scores(self, rows: DataFrame) -> DataFrame:
        both = rows.withColumn("model", F.explode(F.array(F.lit("rf"), F.lit("gb"))))
        return both.withColumn(
            "y_prob",
            F.expr(
                "CASE WHEN model = 'rf' THEN ((SK_ID_CURR * 37 + ord * 11) % 61 + 39 * label) / 100E0"
                " ELSE ((SK_ID_CURR * 17 + ord * 29) % 71 + 25 * label) / 100E0 END"
            ),
        )

    def _pred(self) -> DataFrame:
        slices = self("fx_application").select(ENTITY, *SLICE_COLS)
        # slices join before the rows are repeated for each model
        rows = self._with_scores(lookup(self("fx_snap").drop("snapshot_id"), slices, ENTITY, ["ord"], self.hot))
        rows = threshold_lookup(rows.withColumn("target", F.lit("missed_upcoming_emi")), self("fx_threshold"))
        return rows.withColumns(
            {
                "y_pred_05": apply_threshold("y_prob", 0.5),
                "y_pred_optimal": apply_threshold("y_prob", F.col("threshold")),
            }
        ).drop("threshold")

    def _sql(self, view: str) -> DataFrame:
        text = view.replace("{DD}", SPARK_DD)
        used = {n: self(n) for n in sorted(set(_NAME.findall(text)))}
        if view == VIEWS["fx_installments"]:  # many groups and windows read this join in the layout it leaves
            rows = used["lineitem"].count()
            used["lineitem"] = small_tasks(used["lineitem"], rows, "l_orderkey")
            if many_rows(rows):  # the size of well compressed files hides how many loans a broadcast would hold
                used["orders"] = used["orders"].hint("merge")
        return self.spark.sql(_NAME.sub(r"{\1}", text), **used)


class RawTables(Mapping):
    """The six raw tables by name; a view is built when it is first asked for."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables(RAW_VIEWS[table])

    def __iter__(self):
        return iter(RAW_VIEWS)

    def __len__(self) -> int:
        return len(RAW_VIEWS)
