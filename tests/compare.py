"""Compare a Spark result with a DuckDB result: names, types, rows and values."""

from __future__ import annotations

import glob
import os

import duckdb

# Spark type -> the DuckDB types that hold the same values.
SAME = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(0.0 if v == 0 else v)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in records)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both results agree."""
    found = []
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    types = {c[0]: c[1] for c in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(set(df.columns) ^ set(names))}"]
    for name, kind in df.dtypes:
        if types[name] not in SAME.get(kind, {kind}):
            found.append(f"type of {name}: {kind} vs {types[name]}")
    ours = df.collect()
    a, b = _rows(ours, df.columns), _rows(theirs, names)
    if len(a) != len(b):
        found.append(f"rows {len(a)} vs {len(b)}")
    elif a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        found.append(f"{len(bad)} rows differ, first {bad[0]}; columns {sorted(names)}")
    return found
