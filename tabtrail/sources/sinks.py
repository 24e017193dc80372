"""Table sinks: keyed upserts, appends and full rebuilds on any Spark file format
(S5, S6, S7, S8, S9).

An upsert rewrites the partitions that hold new keys and no others. Tables are partitioned by key
columns (``partition_by``) or, without such, by a bucket of the key's hash (``key_bucket``), so a row's
partition follows from its key. The new rows are made unique and checkpointed into the shared
``spark.checkpoint.dir``, the partitions they touch are read with a partition filter, merged, and
written with dynamic partition overwrite: Spark writes beside the table and exchanges the
written partitions when all tasks have ended, so a job that fails leaves every file of the table as it was.

A rebuild writes a new folder and then takes the table's place by renaming.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrail.operators.dimension import last_per_key, upsert
from tabtrail.session import checkpoint_dir

BUCKET_COL = "key_bucket"
BUCKETS = 16
#: Above this many touched partitions the filter on them is a join instead of literals.
LISTED_PARTITIONS = 1000


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _stored(df: DataFrame) -> T.StructType:
    """The table's schema; stated when reading, so that partition values keep their types."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])


def _touched(rows: DataFrame, parts: Sequence[str]) -> Column | None:
    """The partitions that ``rows`` fall into, as a filter the scan prunes by; None if they are too many to list."""
    found = rows.select(*parts).distinct().limit(LISTED_PARTITIONS + 1).collect()
    if len(found) > LISTED_PARTITIONS:
        return None
    if len(parts) == 1:
        known = [r[0] for r in found if r[0] is not None]
        c = F.col(parts[0])
        return c.isin(known) | c.isNull() if len(known) < len(found) else c.isin(known)
    same = [reduce(and_, [F.col(p).eqNullSafe(F.lit(v)) for p, v in zip(parts, r)]) for r in found]
    return reduce(or_, same) if same else F.lit(False)


def write_upsert(new: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet",
                 partition_by: Sequence[str] | None = None, order_by: Sequence[str] = (),
                 columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Upsert ``new`` into the table at ``path`` on ``keys``; returns the new table.

    Of new rows with one key the last by ``order_by`` counts. ``columns`` are the table's (default: those of
    ``new``). ``partition_by`` must be key columns; a table keeps the partitioning it began with."""
    if partition_by and not set(partition_by) <= set(keys):
        raise ValueError("partition_by must be key columns, else a row could change its partition")
    spark = new.sparkSession
    checkpoint_dir(spark)
    columns = list(columns or new.columns)
    parts = list(partition_by or [BUCKET_COL])
    rows = last_per_key(new, keys, order_by).select(*columns)
    if not partition_by:
        rows = rows.withColumn(BUCKET_COL, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int"))
    rows = rows.checkpoint()
    schema = _stored(rows)
    merged = rows
    if _exists(spark, path):
        current = spark.read.format(fmt).schema(schema).load(path)
        touched = _touched(rows, parts)
        if touched is not None:
            current = current.filter(touched)
        else:
            names = rows.select(*[F.col(p).alias(f"_t_{p}") for p in parts]).distinct()
            current = current.join(names, reduce(and_, [F.col(p).eqNullSafe(F.col(f"_t_{p}")) for p in parts]), "left_semi")
        merged = upsert(current, rows, keys)
    (merged.hint("rebalance", *parts).write.format(fmt).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*parts).save(path))
    return spark.read.format(fmt).schema(schema).load(path).select(*columns)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write ``df`` beside the table at ``path``, then put it in the table's place. Until the new folder is whole the
    table is not touched; afterwards the old folder is renamed, not deleted, before the new one takes its name."""
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    df.write.format(fmt).save(f"{path.rstrip('/')}.new-{tag}")
    target, fs = _path(spark, path)
    fresh, _ = _path(spark, f"{path.rstrip('/')}.new-{tag}")
    aside, _ = _path(spark, f"{path.rstrip('/')}.old-{tag}")
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(fresh, target):
        fs.rename(aside, target)
        raise OSError(f"cannot put the new table in place of {path}")
    fs.delete(aside, True)


def append(df: DataFrame, path: str, fmt: str = "parquet",
           partition_by: Sequence[str] | None = None) -> None:
    """Append (S4 valid chunks by date, S7 reflection log)."""
    w = df.write.format(fmt).mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def scratch_table(spark: SparkSession, name: str) -> str:
    """Path of a new table under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reflection_records(questions: DataFrame, contexts: DataFrame,
                       answer_col: str | None = None) -> DataFrame:
    """Reflection rows with the context stored as a JSON string.

    ``questions``: (id, user_id, query, timestamp); ``contexts``: (user_id, context, ...).
    The answer is the generated text when a generator ran, else the context itself."""
    x = questions.join(contexts, "user_id", "left")
    ctx = F.to_json(F.struct(*[F.col(c) for c in contexts.columns if c != "user_id"]))
    answer = F.col(answer_col) if answer_col else F.col("context")
    return x.select("id", "user_id", "query", answer.alias("response"), ctx.alias("context"),
                    "timestamp")


def insight_records(plan: DataFrame, generated_at_ms: int) -> DataFrame:
    """Daily insight rows (user_id, date, insight_text, suggestions, metadata,
    generated_at) for the days the cache plan marks 'generate' or 'no_activity'."""
    from tabtrail.constants import NO_ACTIVITY_INSIGHT
    x = plan.filter(F.col("action") != "cached")
    text = F.when(F.col("action") == "no_activity", F.lit(NO_ACTIVITY_INSIGHT)) \
        .otherwise(F.concat(F.lit("Top category: "), F.coalesce("top_category", F.lit("-"))))
    meta = F.struct(F.col("total_text").alias("totalTime"),
                    F.col("session_count").alias("sessionCount"),
                    F.col("top_category").alias("topCategory"))
    return x.select("user_id", "date", text.alias("insight_text"),
                    F.array().cast("array<string>").alias("suggestions"),
                    meta.alias("metadata"),
                    F.timestamp_millis(F.lit(generated_at_ms)).alias("generated_at"))


def rebuild_vectors(s: DataFrame, c: DataFrame, path: str, embedder=None,
                    fmt: str = "parquet") -> None:
    """Clear and re-embed every session (text -> vector + metadata), overwrite."""
    from tabtrail.operators.embed import embed_sessions
    from tabtrail.operators.retrieval import vector_records
    from tabtrail.operators.stats import with_category
    sj = with_category(s, c, ("name",))
    emb = embed_sessions(sj, embedder).select(F.col("id").cast("long").alias("vec_id"),
                                              F.col("values").alias("embedding"))
    replace_table(vector_records(emb, s, c), path, fmt)
