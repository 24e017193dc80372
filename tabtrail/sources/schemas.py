"""Schemas of the input and output tables (FIXTURES.md section 1) and readers that
apply them, so production tables in any Spark format load with the right types.

``user_id`` is this library's tenant key; all windows, state and daily aggregates lead
with it. Times are epoch milliseconds (``LongType``); durations are milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

L, S, D, B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "categories": _struct(("id", L, False), ("name", S, False), ("description", S, True),
                          ("color", S, True), ("wellness_type", S, True)),
    "sessions": _struct(("id", L, False), ("user_id", L, False), ("url", S, False),
                        ("title", S, True), ("duration", L, False), ("timestamp", L, False),
                        ("category_id", L, True)),
    "chunks": _struct(("id", L, False), ("user_id", L, False), ("url", S, False),
                      ("title", S, True), ("duration", L, False), ("timestamp", L, False)),
    "tab_events": _struct(("event_id", L, False), ("user_id", L, False), ("ts_ms", L, False),
                          ("kind", S, False), ("tab_id", L, True), ("url", S, True),
                          ("title", S, True)),
    "wellness_scores": _struct(("user_id", L, False), ("date", S, False), ("score", L, True),
                               ("focus_time", L, True), ("learning_time", L, True),
                               ("rest_time", L, True), ("social_time", L, True),
                               ("mindless_time", L, True)),
    "daily_insights": T.StructType([
        T.StructField("user_id", L, False), T.StructField("date", S, False),
        T.StructField("insight_text", S, False),
        T.StructField("suggestions", T.ArrayType(S), False),
        T.StructField("metadata", _struct(("totalTime", S, True), ("sessionCount", L, True),
                                          ("topCategory", S, True)), True),
        T.StructField("generated_at", T.TimestampType(), True)]),
    "reflections": _struct(("id", L, False), ("user_id", L, False), ("query", S, False),
                           ("response", S, False), ("context", S, True), ("timestamp", L, False)),
    "session_vectors": T.StructType([
        T.StructField("id", S, False), T.StructField("values", T.ArrayType(T.FloatType()), False),
        T.StructField("metadata", _struct(("title", S, True), ("url", S, True),
                                          ("timestamp", L, True), ("duration", L, True),
                                          ("category", S, True), ("source", S, True),
                                          ("user_id", L, True)), True)]),
    "category_changes": _struct(("seq", L, False), ("op", S, False), ("id", L, True),
                                ("name", S, True), ("description", S, True), ("color", S, True),
                                ("wellness_type", S, True), ("set_description", B, True)),
    "category_overrides": _struct(("seq", L, False), ("session_id", L, False),
                                  ("category_id", L, True)),
}


def read_input(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
               stream: bool = False) -> DataFrame:
    """Read table ``name`` from ``path`` with its declared schema (batch or stream)."""
    reader = spark.readStream if stream else spark.read
    return reader.format(fmt).schema(SCHEMAS[name]).load(path)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast the columns of ``df`` to the declared schema of ``name``."""
    from pyspark.sql import functions as F
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])
