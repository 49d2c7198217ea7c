"""Named queries over the test tables, with DuckDB texts to check them against."""

from . import aggregates, columns, evaluation, joins, scans, training, windows  # noqa: F401
from .base import REGISTRY, oracle_text, spark_query  # noqa: F401
