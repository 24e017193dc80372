"""ST3: the ingest merge (M1) on a chunk stream with keyed state.

State per (user, url) holds the rows still inside the look-back window (at most the
rows that started in the last ``lookback_ms``). Each micro-batch sorts a key's chunks
by (timestamp, id) and folds them with the same rule as the batch operator; a row is
emitted once it can no longer change -- when a later chunk of the key starts more than
``lookback_ms`` after it, or when the event-time watermark passes its start plus the
look-back (timeout). Output mode is ``append``: every merged row is emitted exactly
once, so for in-order input the stream equals ``merge.ingest_merge``.

Each output row has ``status``: 'final' for merged rows, 'late' for chunks that arrive
after a later chunk of the same key was already folded (out of order); those are
returned unfolded as a rejected output instead of silently changing history.

Spark drops rows behind the event-time watermark before the state function sees them. With
``arrival_col`` (arrival time in epoch ms, as brokers and file sources provide it) no row is
lost that way: a row that arrives more than the watermark delay after its own time is routed to
the 'late' output by a stateless filter first, and all others are at most that delay behind every
time seen, so the watermark is never ahead of them. Without it the drop remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabtrail.constants import INGEST_LOOKBACK_MS, INGEST_MAX_GAP_MS
from tabtrail.operators.merge import INGEST_SCHEMA, IngestFold
from tabtrail.session import ship_package

OUT_SCHEMA = T.StructType(INGEST_SCHEMA.fields + [T.StructField("status", T.StringType())])
STATE_SCHEMA = T.StructType([
    T.StructField("last_ts", T.LongType()), T.StructField("last_id", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("ts", T.ArrayType(T.LongType())),
    T.StructField("durs", T.ArrayType(T.LongType())),
    T.StructField("titles", T.ArrayType(T.StringType())),
    T.StructField("chunks", T.ArrayType(T.LongType())),
])


def _ingest_fn(lookback_ms: int, gap_ms: int, mode: str):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        user, url = key
        live, last = [], None
        if state.exists:
            last_ts, last_id, ids, ts, durs, titles, chunks = state.get
            last = (last_ts, last_id) if last_ts is not None else None
            live = [[i, t, d, ti, c] for i, t, d, ti, c in zip(ids, ts, durs, titles, chunks)]
        fold = IngestFold(lookback_ms, gap_ms, mode, live)
        out = []
        if state.hasTimedOut:
            for r in fold.flush():
                out.append((r[0], user, url, r[3], r[1], r[2], r[4], "final"))
            state.remove()
        else:
            rows = []
            for pdf in pdfs:
                rows.extend(zip(pdf["timestamp"].tolist(), pdf["id"].tolist(),
                                pdf["duration"].tolist(), pdf["title"].tolist()))
            for t, cid, d, ti in sorted(rows, key=lambda r: r[:2]):
                if last is not None and (t, cid) < last:
                    out.append((cid, user, url, ti, t, d, 1, "late"))
                    continue
                last = (t, cid)
                for r in fold.push(cid, t, d, ti):
                    out.append((r[0], user, url, r[3], r[1], r[2], r[4], "final"))
            lv = fold.live
            state.update((last[0] if last else None, last[1] if last else None,
                          [r[0] for r in lv], [r[1] for r in lv], [r[2] for r in lv],
                          [r[3] for r in lv], [r[4] for r in lv]))
            state.setTimeoutTimestamp((max(r[1] for r in lv) if lv else last[0]) + lookback_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=OUT_SCHEMA.fieldNames())
    return fn


def ingest_stream(chunks: DataFrame, lookback_ms: int = INGEST_LOOKBACK_MS,
                  gap_ms: int = INGEST_MAX_GAP_MS, mode: str = "faithful",
                  delay_ms: int = 600_000, arrival_col: str | None = None) -> DataFrame:
    """Streaming M1: ``chunks`` is a streaming DataFrame (id, user_id, url, title,
    timestamp ms, duration); returns finalized merged rows and late chunks, each with a
    ``status`` (append mode)."""
    ship_package(chunks.sparkSession)
    late = None
    if arrival_col is not None:
        behind = F.col(arrival_col) - F.col("timestamp") > F.lit(delay_ms)
        late = chunks.filter(behind).select(
            "id", "user_id", "url", "title", "timestamp", "duration",
            F.lit(1).cast("long").alias("merged_chunks"), F.lit("late").alias("status"))
        chunks = chunks.filter(~F.coalesce(behind, F.lit(False)))
    x = chunks.withColumn("event_time", F.timestamp_millis("timestamp")) \
        .withWatermark("event_time", f"{delay_ms} milliseconds")
    folded = x.groupBy("user_id", "url").applyInPandasWithState(
        _ingest_fn(lookback_ms, gap_ms, mode), OUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
    return folded if late is None else folded.unionByName(late)
