"""K2: session embedding, offline and deterministic by default.

The default embedder hashes the words of the session text (K1) into ``dim`` places (leading
md5 digits modulo ``dim``), counts them and divides by the vector's length, all in SQL
expressions, so cosine equals the dot product. Any other embedder can be plugged in as a pandas
function ``pd.Series[str] -> pd.Series[list[float]]`` run by ``mapInPandas``; rows whose embedding
fails or is None are skipped, like failed upserts, and only those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrail.operators.categorize import FAILED, row_by_row
from tabtrail.session import ship_package

DEFAULT_DIM = 64


def _text(s: DataFrame) -> DataFrame:
    from tabtrail.operators.retrieval import session_text
    cat = F.col("category_name") if "category_name" in s.columns else F.lit(None)
    return s.select(F.col("id").cast("string").alias("id"), session_text(
        F.col("title"), F.col("url"), F.col("duration"), cat, F.col("timestamp")).alias("text"))


def _word_counts(text: Column, dim: int) -> Column:
    """Number of words hashed to each of the ``dim`` places."""
    words = F.array_remove(F.split(F.lower(text), r"\s"), "")
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim)
    return F.transform(F.array(places), lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(p) - F.size(F.array_remove(p, i.cast("long")))))[0]


def embed_sessions(s: DataFrame, embedder: Callable[[pd.Series], pd.Series] | None = None,
                   dim: int = DEFAULT_DIM) -> DataFrame:
    """Rows (id string, values array<float>) for every session that embeds."""
    t = _text(s)
    if embedder is None:
        # counts and length are bound once per row: a column referred to inside a lambda would be
        # put there as its expression and evaluated for every element
        def unit(n: Column) -> Column:
            size = F.sqrt(F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x * x).cast("double"))
            return F.transform(F.array(size), lambda z: F.transform(n, lambda x: (x / z).cast("float")))[0]

        counts = _word_counts(F.col("text"), dim)
        return t.select("id", F.transform(F.array(counts), unit)[0].alias("values"))

    ship_package(s.sparkSession)
    schema = T.StructType([T.StructField("id", T.StringType()),
                           T.StructField("values", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs = row_by_row(lambda part: embedder(part["text"]), pdf)
            kept = [(i, v) for i, v in zip(pdf["id"], vecs) if v is not FAILED and v is not None]
            yield pd.DataFrame(kept, columns=["id", "values"])

    return t.mapInPandas(run, schema)
