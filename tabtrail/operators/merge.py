"""The three session-merge rules (they differ on purpose and stay separate operators).

* ``cleanup_duplicates`` (M2): per (key, url), in time order, a row joins the current
  group when its start is at most ``gap_ms`` after the *previous row's* end; the group
  keeps its first row (id, timestamp, title, ...) and the summed duration.
* ``display_merge`` (M3): per key in global time order, neighbours with the same
  normalised URL and title whose starts are at most ``window_ms`` apart form a group;
  any other row in between breaks it. ``merged_count`` is null for single rows.
* ``ingest_merge`` (M1): the stateful ingest rule -- each chunk merges into the *oldest*
  row of the same URL that started within ``lookback_ms`` if its start is at most
  ``gap_ms`` after that row's accumulated end; the other rows in the look-back are
  deleted (``mode='faithful'`` loses their time, ``'lossless'`` adds it).

M2 and M3 are gap-and-island scans (``ordered.rollup_segments``): one exchange of the rows on
(key, day bucket), where segments become one row each, and one of these rows, so neither a hot key
nor a hot segment lands whole in one task. M1 is history dependent: rows are split into islands
at gaps > ``lookback_ms`` (such a gap always empties the look-back, so islands are
independent), hash-partitioned by (key, url, island), sorted, and folded by a streaming
``mapInPandas`` whose memory is bounded by the rows alive in one look-back window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrail.constants import (
    CLEANUP_MAX_GAP_MS,
    DAY_MS,
    DISPLAY_MERGE_WINDOW_MS,
    INGEST_LOOKBACK_MS,
    INGEST_MAX_GAP_MS,
)
from tabtrail.functions.urls import with_url_parts
from tabtrail.operators.ordered import BUCKET, add_bucket, rollup_segments, segments
from tabtrail.session import ship_package

ORDER = ["timestamp", "id"]


def cleanup_duplicates(s: DataFrame, gap_ms: int = CLEANUP_MAX_GAP_MS,
                       keys: Sequence[str] = ("user_id",),
                       split_ms: int | None = DAY_MS) -> DataFrame:
    """M2: surviving rows with merged durations and ``merged_rows`` (group size)."""
    part = [*keys, "url"]
    carry = [c for c in s.columns if c not in (*part, "id", "timestamp", "duration")]
    x = add_bucket(s.withColumn("_end", F.col("timestamp") + F.col("duration")),
                   "timestamp", split_ms)

    def brk(cur, prev, has_prev):
        return ~has_prev | ((cur("timestamp") - prev("_end")) > gap_ms)
    x = rollup_segments(x, part, ORDER, ["timestamp", "_end"], brk, carry)
    return x.select("id", *part, *carry, "timestamp", "duration", F.col("_rows").alias("merged_rows"))


def cleanup_summary(merged: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """A10: groups that merged more than one row, and rows deleted, per key."""
    return merged.groupBy(*keys).agg(
        F.count_if(F.col("merged_rows") > 1).alias("merged_groups"),
        F.sum(F.col("merged_rows") - 1).alias("deleted_rows"))


def display_merge(s: DataFrame, window_ms: int = DISPLAY_MERGE_WINDOW_MS,
                  keys: Sequence[str] = ("user_id",),
                  split_ms: int | None = DAY_MS) -> DataFrame:
    """M3: read-time merge of neighbouring rows of the same page and title."""
    keys = list(keys)
    carry = [c for c in s.columns if c not in (*keys, "id", "timestamp", "duration")]
    x = add_bucket(with_url_parts(s, "url", "_nurl"), "timestamp", split_ms)

    def brk(cur, prev, has_prev):
        return (~has_prev | ~cur("_nurl").eqNullSafe(prev("_nurl"))
                | ~cur("title").eqNullSafe(prev("title"))
                | ((cur("timestamp") - prev("timestamp")) > window_ms))
    x = rollup_segments(x, keys, ORDER, ["_nurl", "title", "timestamp"], brk, carry)
    n = F.col("_rows")
    return x.select("id", *keys, *carry, "timestamp", "duration", F.when(n > 1, n).alias("merged_count"))


def merged_session_count(merged: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Number of rows after the display merge, per key."""
    return merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("merged_session_count"))


# ---------------------------------------------------------------------------
# M1: ingest merge
# ---------------------------------------------------------------------------

class IngestFold:
    """Sequential ingest rule for one (key, url) stream of chunks in arrival order.

    ``push`` returns rows that can no longer change (started before the look-back of
    the newest chunk); ``flush`` returns the rest. A row is
    ``[id, timestamp, duration, title, chunks]``.
    """

    __slots__ = ("lookback", "gap", "lossless", "live")

    def __init__(self, lookback_ms: int = INGEST_LOOKBACK_MS, gap_ms: int = INGEST_MAX_GAP_MS,
                 mode: str = "faithful", live: list | None = None):
        if mode not in ("faithful", "lossless"):
            raise ValueError("mode must be 'faithful' or 'lossless'")
        self.lookback, self.gap, self.lossless = lookback_ms, gap_ms, mode == "lossless"
        self.live = live if live is not None else []

    def push(self, cid, ts, dur, title) -> list:
        lo = ts - self.lookback
        done = [r for r in self.live if r[1] < lo]
        look = [r for r in self.live if r[1] >= lo]
        if look:
            orig = min(look, key=lambda r: (r[1], r[0]))
            if ts - (orig[1] + orig[2]) <= self.gap:
                orig[2] += dur
                orig[4] += 1
                if self.lossless:
                    orig[2] += sum(r[2] for r in look if r is not orig)
                    orig[4] += sum(r[4] for r in look if r is not orig)
                self.live = [orig]
                return done
        look.append([cid, ts, dur, title, 1])
        self.live = look
        return done

    def flush(self) -> list:
        out, self.live = self.live, []
        return out


INGEST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("timestamp", T.LongType()), T.StructField("duration", T.LongType()),
    T.StructField("merged_chunks", T.LongType()),
])


def _ingest_partition(key_cols: list[str], lookback_ms: int, gap_ms: int, mode: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key, fold, cur_user, cur_url = None, None, None, None
        out: list = []

        def emit(rows, user, url):
            for r in rows:
                out.append((r[0], user, url, r[3], r[1], r[2], r[4]))

        for pdf in batches:
            cols = [pdf[c].tolist() for c in key_cols]
            ids, tss = pdf["id"].tolist(), pdf["timestamp"].tolist()
            durs, titles = pdf["duration"].tolist(), pdf["title"].tolist()
            users, urls = pdf["user_id"].tolist(), pdf["url"].tolist()
            for i in range(len(ids)):
                key = tuple(c[i] for c in cols)
                if key != cur_key:
                    if fold is not None:
                        emit(fold.flush(), cur_user, cur_url)
                    cur_key, cur_user, cur_url = key, users[i], urls[i]
                    fold = IngestFold(lookback_ms, gap_ms, mode)
                emit(fold.push(ids[i], tss[i], durs[i], titles[i]), cur_user, cur_url)
            if out:
                yield pd.DataFrame(out, columns=INGEST_SCHEMA.fieldNames())
                out = []
        if fold is not None:
            emit(fold.flush(), cur_user, cur_url)
        if out:
            yield pd.DataFrame(out, columns=INGEST_SCHEMA.fieldNames())
    return run


def ingest_islands(chunks: DataFrame, lookback_ms: int = INGEST_LOOKBACK_MS,
                   keys: Sequence[str] = ("user_id",),
                   split_ms: int | None = DAY_MS) -> DataFrame:
    """Tag chunks with ``island``: a new island starts when the gap to the previous
    chunk start of the same (key, url) exceeds ``lookback_ms``."""
    part = [*keys, "url"]
    x = add_bucket(chunks, "timestamp", split_ms)

    def brk(cur, prev, has_prev):
        return ~has_prev | ((cur("timestamp") - prev("timestamp")) > lookback_ms)
    return segments(x, part, ORDER, ["timestamp"], brk, out="island").drop(BUCKET, "_start")


def ingest_merge(chunks: DataFrame, lookback_ms: int = INGEST_LOOKBACK_MS,
                 gap_ms: int = INGEST_MAX_GAP_MS, mode: str = "faithful",
                 keys: Sequence[str] = ("user_id",), num_partitions: int | None = None,
                 split_ms: int | None = DAY_MS) -> DataFrame:
    """M1 over a batch of chunks, arrival order = (timestamp, id). Columns: id, user_id,
    url, title, timestamp, duration, merged_chunks. ``keys`` must be ``("user_id",)``
    or a superset containing it.

    The fold resets by itself at gaps longer than the look-back, so each island is a unit
    of work of its own and a hot (key, url) is spread over tasks."""
    ship_package(chunks.sparkSession)
    part = [*keys, "url"]
    x = chunks.select(*part, "id", "title", "timestamp", "duration")
    n = num_partitions or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = ingest_islands(x, lookback_ms, keys, split_ms)
    x = x.withColumn("_isl", F.col("island"))
    x = x.repartition(n, *part, "_isl").sortWithinPartitions(*part, "_isl", *ORDER)
    return x.mapInPandas(_ingest_partition([*part, "_isl"], lookback_ms, gap_ms, mode),
                         INGEST_SCHEMA)
