"""Scans: explicit schemas, only the needed columns, early checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import RAW_SCHEMAS, SNAPSHOT_KEYS

PASSTHROUGH = [*SNAPSHOT_KEYS, "label", "split"]


class MissingInputError(FileNotFoundError):
    """Input tables or columns that a stage needs are absent."""


def scan_csv_projected(
    spark: SparkSession, path: str, table: str | None = None, schema: str | T.StructType | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """CSV with a header and a declared schema.

    Columns are matched by header name, so a file with more columns than the
    schema is read through an all-string schema of its own header first.
    """
    declared = spark.createDataFrame([], schema or RAW_SCHEMAS[table]).schema
    header = spark.read.option("header", True).csv(path).schema
    missing = [f.name for f in declared.fields if f.name not in header.names]
    if missing:
        raise MissingInputError(f"{path}: missing columns {missing}")
    known = {f.name: f for f in declared.fields}
    full = T.StructType([known.get(f.name, T.StructField(f.name, T.StringType())) for f in header.fields])
    names = list(columns) if columns is not None else declared.names
    return spark.read.schema(full).option("header", True).csv(path).select(*names)


def scan_parquet_pruned(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None
) -> DataFrame:
    """Parquet with an optional column list and filter; both reach the file scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns is not None else df


def scan_metric_tables(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Metric tables written as CSV reports, read back with their schemas."""
    return {
        name: spark.read.schema(schemas[name]).option("header", True).csv(path) for name, path in paths.items()
    }


def require_inputs(spark: SparkSession, inputs: dict[str, Sequence[str]]) -> None:
    """Fail before any work if a table or one of its columns is missing."""
    problems = []
    for path, columns in inputs.items():
        try:
            have = set(spark.read.parquet(path).columns)
        except AnalysisException:
            problems.append(f"{path}: not found")
            continue
        lost = [c for c in columns if c not in have]
        if lost:
            problems.append(f"{path}: missing columns {lost}")
    if problems:
        raise MissingInputError("; ".join(problems))


def column_roles(df: DataFrame, passthrough: Sequence[str] = tuple(PASSTHROUGH)) -> dict[str, list[str]]:
    """Numeric, categorical and pass-through columns, from the schema alone."""
    roles: dict[str, list[str]] = {"numeric": [], "categorical": [], "passthrough": []}
    for field in df.schema.fields:
        if field.name in passthrough:
            roles["passthrough"].append(field.name)
        elif isinstance(field.dataType, T.NumericType):
            roles["numeric"].append(field.name)
        else:
            roles["categorical"].append(field.name)
    return roles


def column_role_table(df: DataFrame) -> DataFrame:
    rows = [(c, role) for role, cols in column_roles(df).items() for c in cols]
    return df.sparkSession.createDataFrame(rows, "column_name string, role string")
