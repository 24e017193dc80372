"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabtrail.session import checkpoint_dir, ship_package

#: Rows of one Arrow batch handed to a Python worker. Texts may be long, so a batch is
#: kept to a few hundred rows; a session that sets its own value keeps it.
BATCH_ROWS = 256
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Ready a session for the Python-backed operators: package on the workers, bounded
    Arrow batches, checkpoint folder known."""
    ship_package(spark)
    checkpoint_dir(spark)
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, fn: Callable[[list, list], dict], schema: str) -> DataFrame:
    """Run ``fn(ids, texts) -> {column: list}`` over the Arrow batches of a two-column
    frame (id, text); the id column is returned first under its own name."""
    id_name = df.columns[0]
    id_type = df.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(as_array, out.values())],
                                             names=[id_name, *out])

    return df.mapInArrow(run, f"`{id_name}` {id_type}, {schema}")


def as_array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def fold(doc_id: Column, parts: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``parts``; a null id is the
    empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside one expression (so that it stays
    unevaluated where a CASE branch is not reached)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
