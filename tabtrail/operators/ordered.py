"""Ordered scans over keyed rows that stay parallel when one key is hot.

``lag``/``lead`` and running sums are sequential inside a window partition, so a plain
``Window.partitionBy(user)`` puts a hot user into one task. The split path divides every
key into time buckets (one day) and runs the windows per (key, bucket). The only
cross-bucket information needed -- the neighbour row at a bucket's edge and the latest
segment start before a bucket -- is one row per non-empty bucket, picked from the windowed
rows by a filter, scanned by a window over buckets and joined back on the (key, bucket)
struct. No task ever holds more than one key-day of rows. Spark plans the self-join as two
branches, so the scan pays one extra exchange of the narrow columns the summary reads.

This is the only plan of the operators: it does not depend on measured sizes. Passing
``split_ms=None`` (a plain window per key) is for keys that already hold the day.

``rollup_segments`` gives one row a segment and needs no self-join: segments are summed up inside their
bucket first, and only what touches a bucket's edge goes on to the neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtrail.constants import DAY_MS
from tabtrail.session import checkpoint_dir

BUCKET = "_bucket"
_UNB = Window.unboundedPreceding


def add_bucket(df: DataFrame, time_col: str, split_ms: int | None = DAY_MS) -> DataFrame:
    """Add the bucket column (``time div split_ms``); unchanged for ``None``."""
    if split_ms is None:
        return df
    return df.withColumn(BUCKET, F.floor(F.col(time_col) / F.lit(split_ms)).cast("long"))


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_pk`` = struct(keys, bucket). Structs are never null and compare null
    fields as equal, so partitioning, windows and the carry join all use the same
    non-nullable key: the join is null-safe, Catalyst infers no ``isnotnull`` filter for
    one side only, and the windowed rows need no second exchange for the join."""
    return df.withColumn("_pk", F.struct(*keys, BUCKET))


def _key_of(pk: Column, keys: Sequence[str]) -> Column:
    return F.struct(*[pk[k].alias(k) for k in keys])


def with_neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   fields: Sequence[str], direction: str = "prev",
                   prefix: str | None = None) -> DataFrame:
    """Add ``{prefix}{f}``: field ``f`` of the previous (``prev``) or next (``next``) row
    in ``order`` within ``keys``. ``df`` must carry the bucket column (``add_bucket``);
    order must be ascending and consistent with the bucket (time first).
    """
    prefix = prefix or ("prev_" if direction == "prev" else "next_")
    keys, order, fields = list(keys), list(order), list(fields)
    fn = F.lag if direction == "prev" else F.lead
    back = F.lead if direction == "prev" else F.lag
    if BUCKET not in df.columns:           # not split: one window partition per key
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[fn(f).over(w).alias(prefix + f) for f in fields])
    x = _keyed(df, keys)
    w = Window.partitionBy("_pk").orderBy(*order)
    x = x.select("*", *[fn(f).over(w).alias(prefix + f) for f in fields],
                 fn(F.lit(True)).over(w).isNull().alias("_edge"),      # first (prev) / last (next)
                 back(F.lit(True)).over(w).isNull().alias("_bound_row"))  # last (prev) / first (next)
    # the boundary row handed to the neighbouring bucket: one per bucket
    summary = x.filter("_bound_row").select("_pk", F.struct(*fields).alias("_bound"))
    wk = Window.partitionBy(_key_of(F.col("_pk"), keys)).orderBy(F.col("_pk")[BUCKET])
    carry = summary.select("_pk", fn("_bound").over(wk).alias("_carry"))
    y = x.join(carry, "_pk", "left")
    out = [F.col(c) for c in df.columns]
    for f in fields:
        out.append(F.when(F.col("_edge"), F.col("_carry")[f])
                   .otherwise(F.col(prefix + f)).alias(prefix + f))
    return y.select(*out)


Accessor = Callable[[str], Column]
BreakRule = Callable[[Accessor, Accessor, Column], Column]


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             fields: Sequence[str], brk: BreakRule, out: str = "seg") -> DataFrame:
    """Gap-and-island segmentation in one ordered pass.

    ``brk(cur, prev, has_prev)`` returns true where a segment starts; ``cur(f)`` and
    ``prev(f)`` give field ``f`` of the row and of its predecessor (``fields`` lists the
    predecessor fields it reads), ``has_prev`` is false for a key's first row (always a
    start). The last ``order`` column must be unique within a key (a row id). Adds
    ``_start`` and ``out`` = that id of the segment's first row.

    Rows go through one window pass per (key, bucket); the first row of a bucket and
    the latest start before it are resolved on the buckets' last rows with a window over
    buckets, and joined back on (key, bucket).
    """
    keys, order, fields = list(keys), list(order), list(fields)
    uid = order[-1]
    if BUCKET not in df.columns:           # not split: one window partition per key
        w = Window.partitionBy(*keys).orderBy(*order)
        x = df.select("*", F.lag(F.lit(True)).over(w).isNull().alias("_first"),
                      *[F.lag(f).over(w).alias("_p_" + f) for f in fields])
        start = F.col("_first") | brk(F.col, lambda f: F.col("_p_" + f), ~F.col("_first"))
        x = x.withColumn("_start", start)
        x = x.withColumn(out, F.last(F.when(F.col("_start"), F.col(uid)), ignorenulls=True)
                         .over(w.rowsBetween(_UNB, Window.currentRow)))
        return x.select(*[F.col(c) for c in df.columns], "_start", out)
    x = _keyed(df, keys)
    w = Window.partitionBy("_pk").orderBy(*order)
    x = x.select("*", F.lag(F.lit(True)).over(w).isNull().alias("_first"),
                 F.lead(F.lit(True)).over(w).isNull().alias("_last"),
                 *[F.lag(f).over(w).alias("_p_" + f) for f in fields])
    flag_in = ~F.col("_first") & brk(F.col, lambda f: F.col("_p_" + f), F.lit(True))
    x = x.withColumn("_flag_in", flag_in)
    x = x.withColumn("_seg_in", F.last(F.when(F.col("_flag_in"), F.col(uid)), ignorenulls=True)
                     .over(w.rowsBetween(_UNB, Window.currentRow)))
    # a bucket's last row also carries its first row
    heads = F.first(F.struct(*dict.fromkeys(fields + order))).over(
        w.rowsBetween(_UNB, Window.currentRow))
    summ = x.withColumn("_bfirst", heads).filter("_last").select(
        "_pk", "_bfirst", F.struct(*fields).alias("_blast"), F.col("_seg_in").alias("_bmax"))
    wk = Window.partitionBy(_key_of(F.col("_pk"), keys)).orderBy(F.col("_pk")[BUCKET])
    b = summ.select("_pk", "_bfirst", "_bmax", F.lag("_blast").over(wk).alias("_plast"))
    has_prev = F.col("_plast").isNotNull()
    f1 = ~has_prev | brk(lambda f: F.col("_bfirst")[f], lambda f: F.col("_plast")[f], has_prev)
    b = b.select("_pk", "_bmax", f1.alias("_f1"), F.col("_bfirst")[uid].alias("_k1"))
    b = b.withColumn("_last_start", F.coalesce(F.col("_bmax"), F.when(F.col("_f1"), F.col("_k1"))))
    b = b.select("_pk", "_f1", "_k1",
                 F.last("_last_start", ignorenulls=True).over(wk.rowsBetween(_UNB, -1))
                 .alias("_carry"))
    y = x.join(b, "_pk", "left")
    return y.select(*[F.col(c) for c in df.columns],
                    F.when(F.col("_first"), F.col("_f1")).otherwise(F.col("_flag_in"))
                    .alias("_start"),
                    F.coalesce(F.col("_seg_in"), F.when(F.col("_f1"), F.col("_k1")),
                               F.col("_carry")).alias(out))


def _cut(x: DataFrame, w, start: str, total: str, count: str, first: Column) -> DataFrame:
    """The last row of every run that begins where ``start`` is true, with the run's sums of ``total`` and ``count``
    and ``first`` of its first row (null sums where all values are null). Windows of one order only, so one sort."""
    run = w.rowsBetween(_UNB, Window.currentRow)
    value = F.coalesce(F.col(total), F.lit(0))
    known = F.col(total).isNotNull().cast("long")
    x = x.select("*", F.sum(value).over(run).alias("_ct"), F.sum(count).over(run).alias("_cn"), F.sum(known).over(run).alias("_ck"),
                 F.coalesce(F.lead(start).over(w), F.lit(True)).alias("_ends"))
    begun = F.struct((F.col("_ct") - value).alias("t"), (F.col("_cn") - F.col(count)).alias("n"), (F.col("_ck") - known).alias("k"), first.alias("first"))
    x = x.withColumn("_begun", F.last(F.when(F.col(start), begun), ignorenulls=True).over(run)).filter("_ends")
    out = {"_sum": F.when(F.col("_ck") > F.col("_begun.k"), F.col("_ct") - F.col("_begun.t")), "_rows": F.col("_cn") - F.col("_begun.n"),
           "_head": F.col("_begun.first")}
    return x.withColumns(out).drop("_ct", "_cn", "_ck", "_ends", "_begun")


def rollup_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], brk: BreakRule,
                    carry: Sequence[str], total: str = "duration") -> DataFrame:
    """One row a segment (``brk`` as in ``segments``): keys, ``order`` and ``carry`` of its first row, the sum of
    ``total``, and ``_rows``.

    Rows are exchanged once, by (key, bucket); segments of a bucket come out as one row each. Those at
    a bucket's edge (two a bucket) then meet by key in order, all others stay by bucket, in a second exchange of these rows."""
    keys, order, fields = list(keys), list(order), list(fields)
    split = BUCKET in df.columns
    x = _keyed(df, keys) if split else df.withColumn("_pk", F.struct(*keys))
    w = Window.partitionBy("_pk").orderBy(*order)
    x = x.select("_pk", *dict.fromkeys([*order, *carry, *fields, total]), F.lit(1).cast("long").alias("_one"),
                 F.lag(F.lit(True)).over(w).isNull().alias("_first"), F.lead(F.lit(True)).over(w).isNull().alias("_last"),
                 *[F.lag(f).over(w).alias("_p_" + f) for f in fields])
    x = x.withColumn("_start", F.col("_first") | brk(F.col, lambda f: F.col("_p_" + f), F.lit(True)))
    at_first = F.struct("_first", F.struct(*dict.fromkeys(fields)).alias("cur"), *dict.fromkeys([*order, *carry]))
    x = _cut(x, w, "_start", total, "_one", at_first).select(
        "_pk", "_sum", "_rows", "_head", "_last", F.struct(*dict.fromkeys(fields)).alias("_tail"))
    if split:
        key = _key_of(F.col("_pk"), keys)
        edge = F.col("_head._first") | F.col("_last")
        x = x.withColumn("_meet", F.struct(key.alias("key"), F.when(~edge, F.col("_pk")[BUCKET]).alias("bucket")))
        w = Window.partitionBy("_meet").orderBy(*[F.col("_head")[o] for o in order])
        x = x.select("*", F.lag("_tail").over(w).alias("_prev"))
        joins = (F.col("_head._first") & F.col("_prev").isNotNull()
                 & ~brk(lambda f: F.col("_head.cur")[f], lambda f: F.col("_prev")[f], F.lit(True)))
        x = x.select("_meet", F.col("_sum").alias("_t"), F.col("_rows").alias("_n"), F.col("_head").alias("_h"), (~joins).alias("_start"))
        w = Window.partitionBy("_meet").orderBy(*[F.col("_h")[o] for o in order])
        x = _cut(x, w, "_start", "_t", "_n", F.col("_h")).withColumn("_pk", F.col("_meet.key"))
    return x.select(*[F.col("_pk")[k].alias(k) for k in keys], *[F.col("_head")[c].alias(c) for c in dict.fromkeys([*order, *carry])],
                    F.col("_sum").alias(total), "_rows")


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "position") -> DataFrame:
    """Add ``out``, the row's place (from 1) in ``order`` within its key; ``order`` must be total.

    Rows are dealt to tasks by ranges of (keys, order), which Spark cuts by a sample into equal parts, so a key with very many
    rows, or very many rows of one value, lies in as many parts as it needs. A place is the row number inside (key,
    part) and the rows of the key's earlier parts. The dealt rows are checkpointed: both steps see the same parts."""
    keys = list(keys)
    checkpoint_dir(df.sparkSession)
    part = F.struct(*keys, F.spark_partition_id().cast("long").alias(BUCKET))
    x = df.repartitionByRange(*[F.asc_nulls_first(k) for k in keys], *order).withColumn("_pk", part).checkpoint()
    counts = x.groupBy("_pk").agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(_key_of(F.col("_pk"), keys)).orderBy(F.col("_pk")[BUCKET]).rowsBetween(_UNB, -1)
    before = counts.select("_pk", F.coalesce(F.sum("_n").over(wk), F.lit(0)).alias("_before"))
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy("_pk").orderBy(*order)).cast("long"))
    return x.join(before, "_pk").select(*df.columns, (F.col("_before") + F.col("_rn")).alias(out))
