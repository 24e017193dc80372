"""Build large constant expressions once.

Each Column call is a round trip to the JVM; expressions with dozens of literals (rule
lists, lookup arrays) are therefore written as one SQL expression string, parsed once
per Spark context and reused (expressions are immutable, so sharing is safe).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CACHE: dict[tuple[int, str], Column] = {}


def sql_str(s: str | None) -> str:
    """A Spark SQL string literal (or NULL); backslashes and quotes are escaped."""
    if s is None:
        return "NULL"
    return "'" + s.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'") + "'"


def double_array_sql(values) -> str:
    """SQL text of an array<double> literal (exact: 17 significant digits)."""
    return "array(" + ", ".join("%.17gD" % float(v) for v in values) + ")"


def cached_expr(sql: str) -> Column:
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    key = (sc.applicationId if sc is not None else None, sql)
    col = _CACHE.get(key)
    if col is None:
        col = F.expr(sql)
        _CACHE[key] = col
    return col
