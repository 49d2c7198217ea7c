"""Every query with an oracle text gives DuckDB's answer; the others give rows."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from dueday.catalog.base import REGISTRY, oracle_text, result

QUERIES = list(REGISTRY)
ORACLE = {name: text for name in REGISTRY if (text := oracle_text(name)) is not None}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(data, duck, name):
    # one set of stages for all queries, so shared tables are written once
    assert differences(result(name, data), duck, ORACLE[name]) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_gives_rows(data, name):
    assert result(name, data).count() > 0


def test_entry(spark):
    rows = {r.target_name: r for r in entry.entry(spark).collect()}
    assert set(rows) == {"missed_upcoming_emi", "future_dpd30"}
    assert all(0 < r.positive_rate < 1 for r in rows.values())


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
