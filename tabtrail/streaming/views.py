"""Live forms with keyed state and timers (ST5, ST7, ST8, ST9, S10).

* ``today_stream`` (ST5): runs, time and score of every user's local day, updated each batch.
* ``idle_stream`` (ST8) and ``break_stream`` (ST7): notices that time alone brings about, fired by
  event-time timers, so no further event of the user is needed.
* ``current_session_stream`` (ST9): the open session of every user, again with its elapsed time every
  ``every_ms`` (processing-time timers); ``current_table`` keeps it as a table.
* ``backup_stream`` (S10): the newest chunks of every user.

Event-time forms hold rows that the watermark has not passed and fold the others in order, so rows may come in
any order within the delay; Spark drops rows behind the watermark. State holds a summary and the rows of
the delay, or n rows for the backup. Days end at local midnight (``day_end``), when their state goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabtrail.constants import BREAK_EVERY_MS, IDEAL_SHARES, LOCAL_BACKUP_CHUNKS
from tabtrail.functions.formats import format_clock
from tabtrail.functions.rules import wellness_type
from tabtrail.functions.time import day_string, local_day, ntz_to_ms
from tabtrail.operators.stats import wellness_score, with_category
from tabtrail.session import ship_package
from tabtrail.sources.sinks import write_upsert
from tabtrail.streaming.capture import _internal, _long

TYPES = ("productive", "growth", "rest", "social", "drain")
assert {t for t, _ in IDEAL_SHARES} <= set(TYPES)


def day_end(ms: Column, tz: str) -> Column:
    """Epoch ms of the next local midnight."""
    return ntz_to_ms(F.convert_timezone(F.lit(tz), F.lit("UTC"), F.date_add(local_day(ms, tz), 1).cast("timestamp_ntz")))


def _timed(s: DataFrame, time_col: str, watermark: str) -> DataFrame:
    return s.withColumn("event_time", F.timestamp_millis(F.col(time_col))).withWatermark("event_time", watermark)


def _values(pdfs: Iterator[pd.DataFrame], cols: list[str]) -> list[tuple]:
    return [r for pdf in pdfs for r in zip(*(pdf[c].tolist() for c in cols))]


def _at(mark: int, wanted: int) -> int:
    """A timer must lie after the watermark."""
    return int(max(wanted, mark + 1))


# ---------------------------------------------------------------------------
# ST5: the live day
# ---------------------------------------------------------------------------

DAY_OUT = ("user_id long, date string, session_count long, productive long, growth long, rest long, social long, drain long, "
           "total_time long, rows long, status string")
DAY_STATE = ("runs long, last string, times array<long>, total long, rows long, ts array<long>, ids array<long>, names array<string>, "
             "types array<string>, durations array<long>")


def _add(day: list, row: tuple) -> None:
    """Fold one row (ts, id, name, type, duration) into [runs, last name, times, total, rows]."""
    _, _, name, kind, duration = row
    if name != day[1]:
        day[0], day[1] = day[0] + 1, name
    if duration is not None:
        day[3] += duration
        if kind in TYPES:
            day[2][TYPES.index(kind)] += duration
    day[4] += 1


def _live_day(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    user, date, end = key
    day, waiting = [0, None, [0] * len(TYPES), 0, 0], []
    if state.exists:
        runs, last, times, total, n, *held = state.get
        day, waiting = [runs, last, list(times), total, n], list(zip(*held))
    mark = state.getCurrentWatermarkMs()
    if not state.hasTimedOut:
        new = _values(pdfs, ["timestamp", "id", "category_name", "_type", "duration"])
        waiting = sorted([*waiting, *((*r[:4], _long(r[4])) for r in new)], key=lambda r: r[:2])
    while waiting and waiting[0][0] < mark:
        _add(day, waiting.pop(0))
    shown = [day[0], day[1], list(day[2]), day[3], day[4]]
    for r in waiting:
        _add(shown, r)
    if state.hasTimedOut:
        state.remove()
    else:
        state.update((*day, *([r[i] for r in waiting] for i in range(5))))
        state.setTimeoutTimestamp(_at(mark, end))
    status = "closed" if state.hasTimedOut else "open"
    yield pd.DataFrame([(user, date, shown[0], *shown[2], shown[3], shown[4], status)],
                       columns=["user_id", "date", "session_count", *TYPES, "total_time", "rows", "status"])


def today_stream(s: DataFrame, c: DataFrame, tz: str = "UTC", watermark: str = "2 hours") -> DataFrame:
    """ST5 on a categorised session stream: per user and local day the runs, time and score so far (update
    mode), and once more with status 'closed' when the watermark passes midnight."""
    ship_package(s.sparkSession)
    x = with_category(_timed(s, "timestamp", watermark), c, ("name",))
    ms = F.col("timestamp")
    x = x.select("event_time", "user_id", "id", "timestamp", "category_name", "duration", wellness_type(F.col("category_name")).alias("_type"),
                 day_string(ms, tz).alias("date"), day_end(ms, tz).alias("day_end"))
    t = x.groupBy("user_id", "date", "day_end").applyInPandasWithState(
        _live_day, DAY_OUT, DAY_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return t.select("user_id", "date", "session_count", "total_time", wellness_score(t).alias("wellness_score"), "rows", "status")


# ---------------------------------------------------------------------------
# ST8, ST7: notices fired by time
# ---------------------------------------------------------------------------

IDLE_OUT = "user_id long, kind string, idle_start long, idle_ms long, resumed_by long"
IDLE_STATE = "last long, noticed boolean, ts array<long>, ids array<long>"


def _idle(idle_after_ms: int):
    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (user,) = key
        last, noticed, ts, ids = state.get if state.exists else (None, False, [], [])
        waiting = list(zip(ts, ids))
        if not state.hasTimedOut:
            waiting = sorted([*waiting, *_values(pdfs, ["ts_ms", "event_id"])])
        mark, out = state.getCurrentWatermarkMs(), []

        def notice() -> bool:
            out.append((user, "idle", last, None, None))
            return True

        while waiting and waiting[0][0] < mark:
            t, event = waiting.pop(0)
            if last is not None and t - last > idle_after_ms:
                noticed = noticed or notice()
                out.append((user, "resumed", last, t - last, event))
            last, noticed = t, False
        due = None if last is None or noticed else last + idle_after_ms
        if due is not None and due < mark and not (waiting and waiting[0][0] <= due):
            noticed, due = notice(), None
        state.update((last, noticed, [w[0] for w in waiting], [w[1] for w in waiting]))
        timers = [t for t in (due, waiting[0][0] if waiting else None) if t is not None]
        if timers:
            state.setTimeoutTimestamp(_at(mark, min(timers) + 1))
        if out:
            frame = pd.DataFrame(out, columns=["user_id", "kind", "idle_start", "idle_ms", "resumed_by"])
            yield frame.astype({"idle_ms": "Int64", "resumed_by": "Int64"})
    return run


def idle_stream(events: DataFrame, idle_after_ms: int, watermark: str = "10 seconds") -> DataFrame:
    """ST8: 'idle' once a spell, when the watermark is more than ``idle_after_ms`` past the user's last event;
    'resumed' with the spell's length when the next event has come (the rows of ``capture.idle_spells``)."""
    ship_package(events.sparkSession)
    return _timed(events, "ts_ms", watermark).groupBy("user_id").applyInPandasWithState(
        _idle(idle_after_ms), IDLE_OUT, IDLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


BREAK_OUT = "user_id long, date string, alert_ts long, alert_no long"
BREAK_STATE = "first long, last long, fired long"


def _breaks(every_ms: int):
    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        user, date, end = key
        first, last, fired = state.get if state.exists else (None, None, 0)
        if not state.hasTimedOut:
            rows = _values(pdfs, ["timestamp", "_end"])
            first = min([t for t, _ in rows] + ([] if first is None else [first]))
            last = max([int(e) for _, e in rows if not pd.isna(e)] + ([] if last is None else [last]), default=None)
        mark, out = state.getCurrentWatermarkMs(), []
        upto = min(mark, last) if last is not None else -1
        while first + (fired + 1) * every_ms <= upto:
            fired += 1
            out.append((user, date, first + fired * every_ms, fired))
        due = first + (fired + 1) * every_ms
        more = last is not None and due <= last
        if not more and mark >= end:
            state.remove()
        else:
            state.update((first, last, fired))
            state.setTimeoutTimestamp(_at(mark, due if more else end))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "date", "alert_ts", "alert_no"])
    return run


def break_stream(s: DataFrame, every_ms: int = BREAK_EVERY_MS, tz: str = "UTC", watermark: str = "10 minutes") -> DataFrame:
    """ST7: a reminder for each full ``every_ms`` since the day's first activity, as soon as the watermark reaches it and
    the activity known so far lasts that long (over all batches the rows of ``capture.break_alerts``)."""
    ship_package(s.sparkSession)
    ms = F.col("timestamp")
    x = _timed(s, "timestamp", watermark).select("event_time", "user_id", "timestamp", (ms + F.col("duration")).alias("_end"),
                                                 day_string(ms, tz).alias("date"), day_end(ms, tz).alias("day_end"))
    return x.groupBy("user_id", "date", "day_end").applyInPandasWithState(
        _breaks(every_ms), BREAK_OUT, BREAK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------------------
# ST9: the current session
# ---------------------------------------------------------------------------

NOW_OUT = "user_id long, url string, title string, tab_id long, start_ts long, now_ms long"
NOW_STATE = "url string, title string, tab_id long, start_ts long, last_ts long, last_id long"


def _current(every_ms: int):
    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (user,) = key
        *running, last_ts, last_id = state.get if state.exists else (None,) * 6
        if not state.hasTimedOut:
            rows = _values(pdfs, ["ts_ms", "event_id", "kind", "tab_id", "url", "title"])
            for ts, event, kind, tab, url, title in sorted(rows, key=lambda r: r[:2]):
                if last_ts is not None and (ts, event) < (last_ts, last_id):
                    continue        # older than what is shown
                last_ts, last_id = ts, event
                internal = _internal(url)
                if kind == "focus_gained" and internal or kind == "url_updated" and url is not None and url == running[0]:
                    continue
                starts = kind in ("activated", "url_updated", "focus_gained") and not internal
                running = [url, title, _long(tab), ts] if starts else [None] * 4
        state.update((*running, last_ts, last_id))
        if running[3] is not None:
            state.setTimeoutDuration(every_ms)
        now = state.getCurrentProcessingTimeMs()
        frame = pd.DataFrame([(user, *running, now)], columns=["user_id", "url", "title", "tab_id", "start_ts", "now_ms"])
        yield frame.astype({"tab_id": "Int64", "start_ts": "Int64"})
    return run


def current_session_stream(events: DataFrame, every_ms: int = 30_000) -> DataFrame:
    """ST9: a row a user with events in the batch, and every ``every_ms`` for each open session (update mode). A user
    without an open session has null url and start. Timers of processing time keep such a query running, so
    it takes a processing-time trigger; ``availableNow`` would not end."""
    ship_package(events.sparkSession)
    x = events.groupBy("user_id").applyInPandasWithState(_current(every_ms), NOW_OUT, NOW_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    elapsed = F.col("now_ms") - F.col("start_ts")
    return x.select("user_id", "url", "title", "tab_id", "start_ts", "now_ms", elapsed.alias("elapsed_ms"), format_clock(elapsed).alias("elapsed_text"))


def current_table(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body that keeps the rows of ``current_session_stream`` as a table, one row a user."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        write_upsert(batch, path, ["user_id"], order_by=["now_ms"])
    return run


# ---------------------------------------------------------------------------
# The newest chunks
# ---------------------------------------------------------------------------

CHUNK = ["timestamp", "id", "url", "title", "duration"]
BACKUP_OUT = "user_id long, timestamp array<long>, id array<long>, url array<string>, title array<string>, duration array<long>"
BACKUP_STATE = "timestamp array<long>, id array<long>, url array<string>, title array<string>, duration array<long>"


def _backup(n: int):
    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (user,) = key
        rows = list(zip(*state.get)) if state.exists else []
        for pdf in pdfs:        # one Arrow batch at a time, so a hot user never has all its rows here
            rows += [(*r[:4], _long(r[4])) for r in zip(*(pdf[c].tolist() for c in CHUNK))]
            rows = sorted(rows, key=lambda r: r[:2], reverse=True)[:n]
        held = tuple([r[i] for r in rows] for i in range(len(CHUNK)))
        state.update(held)
        yield pd.DataFrame({"user_id": [user]} | {c: [v] for c, v in zip(CHUNK, held)})
    return run


def backup_stream(chunks: DataFrame, n: int = LOCAL_BACKUP_CHUNKS) -> DataFrame:
    """Per user with chunks in the batch, its newest ``n`` chunks so far as an array, newest first (update mode).
    ``backup_rows`` gives them as rows."""
    ship_package(chunks.sparkSession)
    x = chunks.select("user_id", *CHUNK).groupBy("user_id").applyInPandasWithState(
        _backup(n), BACKUP_OUT, BACKUP_STATE, "update", GroupStateTimeout.NoTimeout)
    return x.select("user_id", F.arrays_zip(*CHUNK).alias("chunks"))


def backup_rows(backup: DataFrame) -> DataFrame:
    return backup.select("user_id", F.inline("chunks"))
