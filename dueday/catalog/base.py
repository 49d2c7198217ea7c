"""Registration of queries with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import Stages
from ..session import scratch_path
from ..sources.fixtures import DUCK_DD, VIEWS, RawTables, Tables
from .oracle_views import ORACLE_VIEWS

_ALL_VIEWS = {**{name: text.replace("{DD}", DUCK_DD) for name, text in VIEWS.items()}, **ORACLE_VIEWS}
_VIEW_NAME = re.compile(r"\b((?:fx|ov)_\w+)\b")


class Data(Stages):
    """The stages over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.tables = Tables(spark, sf_dir)
        super().__init__(RawTables(self.tables))
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def hot(self):
        return self.tables.hot  # one count serves the views and the stages

    @property
    def missed_rows(self):
        return self.tables("fx_snap").drop("ord")

    def __call__(self, name: str) -> DataFrame:
        return self.tables(name)

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)


@dataclass
class Query:
    run: Callable[[Data], DataFrame]
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)


SINGLE = -1

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, **digits: int):
    """Register a query. ``digits`` rounds its floating-point columns on both
    sides, because the two engines add doubles in different orders; ``SINGLE``
    rounds to single precision, for means of amounts."""

    def register(run: Callable[[Data], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(run, sql, digits)
        return run

    return register


def result(name: str, data: Data) -> DataFrame:
    """The query's result with its floating-point columns rounded for comparison."""
    entry = REGISTRY[name]
    df = entry.run(data)
    for c, digits in entry.digits.items():
        df = df.withColumn(c, F.col(c).cast("float").cast("double") if digits == SINGLE else F.round(c, digits))
    return df


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: result(name, Data(spark, sf_dir))


def oracle_text(name: str) -> str | None:
    """The oracle SQL with every view it uses in front, dependencies first."""
    entry = REGISTRY[name]
    if entry.sql is None:
        return None
    body = entry.sql.strip()
    if entry.digits:
        parts = ", ".join(
            f'CAST(CAST("{c}" AS FLOAT) AS DOUBLE) AS "{c}"' if d == SINGLE else f'round("{c}", {d}) AS "{c}"'
            for c, d in entry.digits.items()
        )
        body = f"SELECT * REPLACE ({parts}) FROM ({body}) final"
    ordered: list[str] = []

    def need(text: str) -> None:
        for view in dict.fromkeys(_VIEW_NAME.findall(text)):
            if view in _ALL_VIEWS and view not in ordered:
                need(_ALL_VIEWS[view])
                ordered.append(view)

    need(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{v} AS ({_ALL_VIEWS[v].strip()})" for v in ordered)
    return f"WITH {ctes}\n{body}"
