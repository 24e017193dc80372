"""Readers for the input tables and the category dimension.

All readers return lazy DataFrames. Catalyst prunes the columns that a caller does not use and
pushes filters on stored columns into the Parquet scan; filters on derived columns stay above
it, which is why the fixtures take time bounds (see ``fixtures.sessions``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabtrail.constants import CATEGORY_SEED

CATEGORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("color", T.StringType(), True),
    T.StructField("wellness_type", T.StringType(), True),
])


_SCHEMAS: dict[tuple, T.StructType] = {}


def read_table(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Read ``{base}/{name}.{fmt}`` (any Spark batch format).

    The schema is found once per application and path; files are listed at each call, so a table
    written meanwhile is read as it is. A new schema needs a new path."""
    path = f"{base.rstrip('/')}/{name}.{fmt}"
    from tabtrail.session import app_key
    key = (app_key(spark), path, fmt)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.format(fmt).load(path).schema
    return spark.read.format(fmt).schema(_SCHEMAS[key]).load(path)


def literal_frame(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small constant table as a JVM-side local relation (SQL ``VALUES``): no Python
    RDD, exact size known to the planner, one parser call."""
    from tabtrail.functions.sqlexpr import sql_str

    def lit(v):
        return "NULL" if v is None else (sql_str(v) if isinstance(v, str) else repr(v))
    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST(col{i + 1} AS {f.dataType.simpleString()}) AS {f.name}"
                     for i, f in enumerate(schema.fields))
    return spark.sql(f"SELECT {cols} FROM VALUES {values}")


def seed_categories(spark: SparkSession) -> DataFrame:
    """The eight seeded categories (id = position)."""
    return literal_frame(spark, CATEGORY_SEED, CATEGORY_SCHEMA)
