"""ST1/ST2 on a stream: tab events -> closed sessions -> autosave chunks.

Keyed state per user holds the running session (URL, title, start, tab, start event) and the
last event folded. Events of a micro-batch are folded in (ts_ms, event_id) order with the capture
rules (see ``operators.capture``); a session is emitted with status 'closed' when the event that
ends or replaces it arrives. The open session stays in state until then, however long that takes
(it is what ``current_session`` shows); the state of a user is one row.

An event older than the last one folded is not folded into the past: it comes out with status
'late', its own time as start and end and no duration. No watermark is set, so Spark drops
nothing before the fold. For in-order input the closed rows equal ``operators.capture.tab_sessions``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabtrail.constants import (
    AUTOSAVE_MS,
    INTERNAL_URL_PARTS,
    INTERNAL_URL_PREFIXES,
    MIN_CHUNK_MS,
)
from tabtrail.operators.capture import session_chunks
from tabtrail.session import ship_package

SESSION_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("tab_id", T.LongType()), T.StructField("start_ts", T.LongType()),
    T.StructField("end_ts", T.LongType()), T.StructField("elapsed_ms", T.LongType()),
    T.StructField("duration", T.LongType()), T.StructField("end_kind", T.StringType()),
    T.StructField("status", T.StringType()),
])
STATE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("tab_id", T.LongType()), T.StructField("start_ts", T.LongType()),
    T.StructField("event_id", T.LongType()), T.StructField("last_ts", T.LongType()),
    T.StructField("last_id", T.LongType()),
])


def _internal(url) -> bool:
    if url is None:
        return False
    return any(url.startswith(p) for p in INTERNAL_URL_PREFIXES) or \
        any(p in url for p in INTERNAL_URL_PARTS)


def _recorded(gap: int, overwritten: bool) -> int:
    full = gap // AUTOSAVE_MS
    rest = gap - full * AUTOSAVE_MS
    return full * AUTOSAVE_MS + (rest if (not overwritten and rest >= MIN_CHUNK_MS) else 0)


def _long(v):
    """An integer, or None for a missing value (a null makes pandas hold floats)."""
    return None if pd.isna(v) else int(v)


def _fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (user,) = key
    held = list(state.get) if state.exists else [None] * 7
    running, last = (held[:5] if held[0] is not None else None), (held[5], held[6])
    if last[0] is None:
        last = None
    rows = []
    for pdf in pdfs:
        rows.extend(zip(pdf["ts_ms"].tolist(), pdf["event_id"].tolist(), pdf["kind"].tolist(),
                        map(_long, pdf["tab_id"].tolist()), pdf["url"].tolist(), pdf["title"].tolist()))
    out = []
    for ts, eid, kind, tab, url, title in sorted(rows, key=lambda r: r[:2]):
        if last is not None and (ts, eid) < last:
            out.append((user, eid, url, title, tab, ts, ts, 0, 0, kind, "late"))
            continue
        last = (ts, eid)
        internal = _internal(url)
        if kind == "focus_gained" and internal:
            continue
        if kind == "url_updated" and running is not None and url == running[0]:
            continue
        if running is not None:
            gap = ts - running[3]
            out.append((user, running[4], running[0], running[1], running[2], running[3],
                        ts, gap, _recorded(gap, kind == "focus_gained"), kind, "closed"))
        starts = kind in ("activated", "url_updated", "focus_gained") and not internal
        running = [url, title, tab, ts, eid] if starts else None
    if last is not None:
        state.update((*(running or [None] * 5), *last))
    if out:
        frame = pd.DataFrame(out, columns=SESSION_SCHEMA.fieldNames())
        yield frame.astype({"tab_id": "Int64"})


def capture_stream(events: DataFrame) -> DataFrame:
    """Streaming ST1: ``events`` (event_id, user_id, ts_ms, kind, tab_id, url, title)
    -> closed sessions and late events (append mode)."""
    ship_package(events.sparkSession)
    return events.groupBy("user_id").applyInPandasWithState(
        _fold, SESSION_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def chunk_stream(sessions: DataFrame) -> DataFrame:
    """ST2 on the stream: autosave chunks of the closed sessions (stateless)."""
    return session_chunks(sessions.filter(F.col("status") == "closed"))
