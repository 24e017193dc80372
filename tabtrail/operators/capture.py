"""Browser capture re-expressed over event tables (ST1/ST2 batch, ST6-ST9, S10).

Tab events ``(user_id, event_id, ts_ms, kind, tab_id, url, title)`` drive the session
state machine of the capture extension:

* ``activated``/``url_updated`` end the running session and start one on an external
  page; a ``url_updated`` to the URL of the running session is a no-op;
* ``focus_lost``/``suspend`` end the running session;
* ``focus_gained`` on an external page replaces the running session without saving its
  unsaved remainder (only whole 30 s autosave chunks survive); on an internal page it is
  a no-op.

After dropping the no-op rows, the URL of the running session after each event depends
on that event alone, so the machine reduces to one ``lag`` (to find no-op URL updates)
and one ``lead`` (end of each session) per user, both via the bucketed neighbour scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtrail.constants import (
    AUTOSAVE_MS,
    BREAK_EVERY_MS,
    CHUNK_ID_FACTOR,
    DAY_MS,
    LATE_NIGHT_FROM_HOUR,
    LATE_NIGHT_UNTIL_HOUR,
    LOCAL_BACKUP_CHUNKS,
    MIN_CHUNK_MS,
)
from tabtrail.functions.formats import format_clock, idiv
from tabtrail.functions.rules import is_internal_url
from tabtrail.functions.time import day_string, local_hour
from tabtrail.operators.ordered import BUCKET, add_bucket, with_neighbour
from tabtrail.operators.stats import top_n

KEYS = ("user_id",)
ORDER = ["ts_ms", "event_id"]
STARTING_KINDS = ["activated", "url_updated", "focus_gained"]


def effective_events(events: DataFrame, keys: Sequence[str] = KEYS,
                     split_ms: int | None = DAY_MS) -> DataFrame:
    """Events that change state, with ``_state`` (URL of the session running after the
    event, null when none) and ``next_ts_ms`` / ``next_kind`` of the following event."""
    url = F.col("url")
    ev = events.filter(~((F.col("kind") == "focus_gained") & is_internal_url(url)))
    starts = F.col("kind").isin(*STARTING_KINDS) & ~is_internal_url(url)
    ev = ev.withColumn("_state", F.when(starts, url))
    ev = add_bucket(ev, "ts_ms", split_ms)
    ev = with_neighbour(ev, keys, ORDER, ["_state"], "prev")
    noop = (F.col("kind") == "url_updated") & F.coalesce(url == F.col("prev__state"), F.lit(False))
    ev = ev.filter(~noop).drop("prev__state")
    return with_neighbour(ev, keys, ORDER, ["ts_ms", "kind"], "next")


def tab_sessions(events: DataFrame, keys: Sequence[str] = KEYS,
                 split_ms: int | None = DAY_MS) -> DataFrame:
    """Closed sessions: start event, page, start/end, elapsed and recorded duration."""
    ev = effective_events(events, keys, split_ms)
    x = ev.filter(F.col("_state").isNotNull() & F.col("next_ts_ms").isNotNull())
    gap = F.col("next_ts_ms") - F.col("ts_ms")
    full = idiv(gap, AUTOSAVE_MS)
    rest = gap - full * AUTOSAVE_MS
    overwritten = F.col("next_kind") == "focus_gained"
    recorded = full * AUTOSAVE_MS + F.when(~overwritten & (rest >= MIN_CHUNK_MS), rest) \
        .otherwise(F.lit(0))
    return x.select(*keys, "event_id", "url", "title", "tab_id",
                    F.col("ts_ms").alias("start_ts"), F.col("next_ts_ms").alias("end_ts"),
                    gap.alias("elapsed_ms"), recorded.alias("duration"),
                    F.col("next_kind").alias("end_kind"))


def session_chunks(sessions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """ST2: autosave chunks of closed tab sessions: one per full 30 s, then the
    remainder when the session ended normally and the remainder is at least 3 s. Ids are
    ``event_id * CHUNK_ID_FACTOR + j``: unique for sessions of up to a year and event ids up
    to 8 * 10^12."""
    elapsed = F.col("elapsed_ms")
    full = idiv(elapsed, AUTOSAVE_MS)
    rest = elapsed - full * AUTOSAVE_MS
    tail = (F.col("end_kind") != "focus_gained") & (rest >= MIN_CHUNK_MS)
    n = full + F.when(tail, F.lit(1)).otherwise(F.lit(0))
    x = sessions.filter(n > 0).select(
        *keys, "event_id", "url", "title", "start_ts", elapsed.alias("_el"),
        F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("j"))
    j = F.col("j")
    return x.select(
        (F.col("event_id") * CHUNK_ID_FACTOR + j).alias("id"), *keys, "url", "title",
        (F.col("start_ts") + j * AUTOSAVE_MS).alias("timestamp"),
        F.least(F.lit(AUTOSAVE_MS).cast("long"), F.col("_el") - j * AUTOSAVE_MS).alias("duration"),
    ).filter(F.col("duration") >= MIN_CHUNK_MS)


def current_session(events: DataFrame, now_ms: int, keys: Sequence[str] = KEYS,
                    split_ms: int | None = DAY_MS) -> DataFrame:
    """ST9: the session still open after the last event, with elapsed time at ``now``."""
    ev = effective_events(events, keys, split_ms)
    x = ev.filter(F.col("_state").isNotNull() & F.col("next_ts_ms").isNull())
    elapsed = F.lit(now_ms) - F.col("ts_ms")
    return x.select(*keys, "url", "title", "tab_id", F.col("ts_ms").alias("start_ts"),
                    elapsed.alias("elapsed_ms"), format_clock(elapsed).alias("elapsed_text"))


def late_night_alerts(s: DataFrame, tz: str = "UTC", keys: Sequence[str] = KEYS,
                      time_col: str = "timestamp") -> DataFrame:
    """ST6: at most one reminder per key and night: first activity with local hour in
    [1, 7)."""
    h = local_hour(F.col(time_col), tz)
    x = s.filter((h >= LATE_NIGHT_FROM_HOUR) & (h < LATE_NIGHT_UNTIL_HOUR))
    return x.groupBy(*keys, day_string(F.col(time_col), tz).alias("night")).agg(
        F.min(time_col).alias("alert_ts"), F.count(F.lit(1)).alias("late_sessions"))


def break_alerts(s: DataFrame, every_ms: int = BREAK_EVERY_MS, tz: str = "UTC",
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """ST7 re-aimed: per key and day, one reminder per full ``every_ms`` between the
    first activity start and the last activity end."""
    g = s.groupBy(*keys, day_string(F.col("timestamp"), tz).alias("date")).agg(
        F.min("timestamp").alias("_first"),
        F.max(F.col("timestamp") + F.col("duration")).alias("_last"))
    g = g.filter(F.col("_last") >= F.col("_first") + every_ms)
    x = g.select(*keys, "date", "_first", F.explode(F.sequence(
        F.col("_first") + every_ms, F.col("_last"), F.lit(every_ms).cast("long"))).alias("alert_ts"))
    return x.select(*keys, "date", "alert_ts",
                    idiv(F.col("alert_ts") - F.col("_first"), every_ms).alias("alert_no"))


def idle_spells(events: DataFrame, idle_after_ms: int, keys: Sequence[str] = KEYS,
                split_ms: int | None = DAY_MS) -> DataFrame:
    """ST8 re-aimed: gaps longer than ``idle_after_ms`` between a key's consecutive
    events; one row per spell (start = previous event, length)."""
    x = add_bucket(events, "ts_ms", split_ms)
    x = with_neighbour(x, keys, ORDER, ["ts_ms"], "prev")
    gap = F.col("ts_ms") - F.col("prev_ts_ms")
    return x.filter(gap > idle_after_ms).select(
        *keys, F.col("prev_ts_ms").alias("idle_start"), gap.alias("idle_ms"),
        F.col("event_id").alias("resumed_by"))


def last_n_per_user(chunks: DataFrame, n: int = LOCAL_BACKUP_CHUNKS,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest ``n`` chunks per key (bounded local backup)."""
    return top_n(chunks, n, [F.col("timestamp").desc(), F.col("id").desc()], keys)


__all__ = ["effective_events", "tab_sessions", "session_chunks", "current_session",
           "late_night_alerts", "break_alerts", "idle_spells", "last_n_per_user", "BUCKET"]
