"""Live stream forms against their batch operators, batch by batch."""

import glob
import os
import shutil
import tempfile
import time

from pyspark.sql import functions as F

from tabtrail.operators import capture as cp
from tabtrail.operators import categorize as cg
from tabtrail.operators import merge as mg
from tabtrail.operators import stats as st
from tabtrail.sources import fixtures as fx
from tabtrail.streaming import live, views

SF = "/root/testdata/sf0.001"
T0 = 1704067200000          # 2024-01-01T00:00Z
MIN, HOUR, DAY = 60_000, 3_600_000, 86_400_000
SESSION = "id long, user_id long, url string, title string, duration long, timestamp long, category_id long"
TAB = "event_id long, user_id long, ts_ms long, kind string, tab_id long, url string, title string"


def source(spark, frames):
    """A folder with one file a frame, in this order."""
    src = tempfile.mkdtemp(prefix="tt-live-")
    for i, f in enumerate(frames):
        tmp = tempfile.mkdtemp(prefix="tt-part-") + "/x"
        f.coalesce(1).write.parquet(tmp)
        name = f"{src}/p{i:03d}.parquet"
        shutil.copy(glob.glob(f"{tmp}/part-*")[0], name)
        os.utime(name, (1_700_000_000 + 10 * i,) * 2)
    return src


def run(spark, frames, build, mode="append", each=None, until=None):
    """Rows that each micro-batch gives, as lists; with ``until`` batches go on till it is true."""
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(source(spark, frames))
    out = []

    def take(df, epoch):
        out.append(df.collect())
        if each:
            each(df, epoch)
    q = (build(stream).writeStream.outputMode(mode).foreachBatch(take)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tt-ckpt-"))
         .trigger(**({"processingTime": "100 milliseconds"} if until else {"availableNow": True})).start())
    if until:
        end = time.time() + 120
        while not until() and time.time() < end and q.isActive:
            time.sleep(.1)
        q.stop()
    q.awaitTermination(300)
    return out


def frames_of(spark, batches, schema):
    return [spark.createDataFrame(b, schema) for b in batches]


def slices(df, col, n):
    """n frames by time."""
    rows = [r for r in df.orderBy(col).collect()]
    size = -(-len(rows) // n)
    return [df.sparkSession.createDataFrame(rows[i:i + size], df.schema) for i in range(0, len(rows), size)]


def test_live_day_equals_batch_after_every_batch(spark):
    s, c = fx.categorized_sessions(spark, SF), fx.categories(spark)
    parts = slices(s, "timestamp", 4)
    parts = [p.orderBy(F.rand(1)) for p in parts]         # any order inside a batch
    got = run(spark, parts, lambda x: views.today_stream(x, c, "Europe/Moscow", "3 hours"), "update")
    seen, latest, closed = None, {}, 0
    for i, rows in enumerate(got):
        for r in rows:
            latest[r.user_id, r.date] = (r.session_count, r.total_time, r.wellness_score)
            closed += r.status == "closed"
        if i < len(parts):
            seen = parts[i] if seen is None else seen.union(parts[i])
            runs = st.category_runs(seen, c, "Europe/Moscow")
            day = st.wellness_daily(seen, c, "Europe/Moscow").join(runs, ["user_id", "date"])
            assert latest == {(r.user_id, r.date): (r.session_count, r.total_time, r.score) for r in day.collect()}
    assert closed > 300
    day = st.in_range(s, T0 + 5 * DAY - 3 * HOUR, T0 + 6 * DAY - 3 * HOUR - 1)
    want = st.today_stats(day, c, T0 + 5 * DAY - 3 * HOUR, None, "Europe/Moscow").collect()
    assert want and all(latest[r.user_id, "2024-01-06"] == (r.session_count, r.total_time, r.wellness_score) for r in want)


def test_live_day_takes_rows_out_of_order(spark):
    c = fx.categories(spark)
    row = lambda i, t, cat: (i, 1, "u", None, 1000, T0 + t, cat)
    batches = [[row(1, 10 * MIN, 1), row(2, 30 * MIN, 1)], [row(3, 20 * MIN, 2)], [row(4, 25 * MIN, None), row(5, 4 * HOUR, 1)], [row(6, 5 * HOUR, 2)]]
    got = run(spark, frames_of(spark, batches, SESSION), lambda x: views.today_stream(x, c, watermark="2 hours"), "update")
    assert [[(r.session_count, r.total_time, r["rows"]) for r in b] for b in got[:4]] == [[(1, 2000, 2)], [(3, 3000, 3)], [(4, 5000, 5)], [(5, 6000, 6)]]


def test_idle_and_break_notices_come_without_another_event(spark):
    e = lambda i, u, t: (i, u, T0 + t, "activated", 1, "https://a.example/", "a")
    batches = [[e(1, 1, 0), e(2, 2, 0)], [e(3, 2, 5 * MIN)], [e(4, 2, 6 * MIN)], [e(5, 1, 9 * MIN), e(6, 2, 9 * MIN)], [e(7, 2, 30 * MIN)]]
    got = run(spark, frames_of(spark, batches, TAB), lambda x: views.idle_stream(x, MIN))
    when = [(i, r.kind, r.idle_start - T0, r.idle_ms) for i, b in enumerate(got) for r in b if r.user_id == 1]
    noticed = next(w for w in when if w[1] == "idle")
    assert noticed[2:] == (0, None) and noticed[0] < 4            # before user 1 is heard of again
    assert [w[1:] for w in when if w[1] == "resumed"] == [("resumed", 0, 9 * MIN)]
    assert len([w for w in when if w[1:3] == ("idle", 0)]) == 1
    s = lambda i, u, t, d: (i, u, "u", None, d, T0 + t, None)
    batches = [[s(1, 1, 0, 3 * HOUR)], [s(2, 2, 70 * MIN, 1000)], [s(3, 2, 4 * HOUR, 1000)], [s(4, 2, 40 * HOUR, 0)]]
    got = run(spark, frames_of(spark, batches, SESSION), lambda x: views.break_stream(x))
    first = [(i, r.alert_no) for i, b in enumerate(got) for r in b if r.user_id == 1]
    assert [n for _, n in first] == [1, 2, 3] and first[0][0] <= 4
    assert [r.alert_no for b in got for r in b if r.user_id == 2] == [1, 2]


def test_idle_and_breaks_equal_batch(spark):
    ev = fx.tab_events(spark, SF)
    end = spark.createDataFrame([(-1, -1, 1_800_000_000_000, "suspend", None, None, None)], TAB)
    got = [r for b in run(spark, [*slices(ev, "ts_ms", 3), end], lambda x: views.idle_stream(x, 10 * MIN)) for r in b if r.user_id >= 0]
    want = cp.idle_spells(ev, 10 * MIN).collect()
    key = lambda r: (r.user_id, r.idle_start, r.idle_ms, r.resumed_by)
    assert sorted(key(r) for r in got if r.kind == "resumed") == sorted(map(key, want)) and len(want) > 20
    idle = [(r.user_id, r.idle_start) for r in got if r.kind == "idle"]
    assert len(idle) == len(set(idle)) and {(r.user_id, r.idle_start) for r in want} <= set(idle)
    s = fx.sessions(spark, SF)
    end = spark.createDataFrame([(-1, -1, "s", None, 1000, 1_800_000_000_000, None)], SESSION)
    got = [r for b in run(spark, [*slices(s, "timestamp", 3), end], lambda x: views.break_stream(x, tz="Europe/Moscow")) for r in b if r.user_id >= 0]
    key = lambda r: (r.user_id, r.date, r.alert_ts, r.alert_no)
    assert sorted(map(key, got)) == sorted(map(key, cp.break_alerts(s, tz="Europe/Moscow").collect())) and got


def test_current_session_equals_batch_at_each_trigger(spark):
    ev = fx.tab_events(spark, SF)
    parts = slices(ev, "ts_ms", 3)
    path = tempfile.mkdtemp(prefix="tt-now-") + "/t"
    state = {"seen": None, "n": 0}

    def each(df, epoch):
        views.current_table(path)(df, epoch)
        if state["n"] == len(parts) or df.isEmpty():
            return
        part = parts[state["n"]]
        state["seen"] = part if state["seen"] is None else state["seen"].union(part)
        table = spark.read.parquet(path)
        shown = {(r.user_id, r.url, r.title, r.tab_id, r.start_ts) for r in table.where("url IS NOT NULL").collect()}
        want = cp.current_session(state["seen"], 1_800_000_000_000)
        assert shown == {(r.user_id, r.url, r.title, r.tab_id, r.start_ts) for r in want.collect()} and shown
        for r in table.where("url IS NOT NULL").limit(3).collect():
            now = cp.current_session(state["seen"].where(F.col("user_id") == r.user_id), r.now_ms).first()
            assert (r.elapsed_ms, r.elapsed_text) == (now.elapsed_ms, now.elapsed_text)
        state["n"] += 1
    run(spark, parts, lambda x: views.current_session_stream(x, 3_600_000), "update", each, lambda: state["n"] == len(parts))
    assert state["n"] == len(parts)


def test_current_session_comes_again_while_nothing_happens(spark):
    src = source(spark, [spark.createDataFrame([(1, 1, T0, "activated", 7, "https://a.example/", "a")], TAB)])
    stream = spark.readStream.schema(spark.createDataFrame([], TAB).schema).parquet(src)
    rows = []
    q = (views.current_session_stream(stream, 500).writeStream.outputMode("update").foreachBatch(lambda df, e: rows.extend(df.collect()))
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tt-ckpt-")).trigger(processingTime="500 milliseconds").start())
    until = time.time() + 60
    while len(rows) < 3 and time.time() < until:
        time.sleep(.2)
    q.stop()
    assert len(rows) >= 3 and len({r.elapsed_ms for r in rows}) == len(rows)
    assert all(r.elapsed_ms == r.now_ms - T0 and r.tab_id == 7 for r in rows)


def test_backup_equals_batch_at_every_cut(spark):
    ch = fx.chunks(spark, SF)
    parts = slices(ch.where("user_id < 4"), "id", 3)[::-1]       # newest first: older ones push nothing out
    seen, latest = None, {}
    for part, rows in zip(parts, run(spark, parts, lambda x: views.backup_stream(x, 50), "update")):
        seen = part if seen is None else seen.union(part)
        latest |= {r.user_id: [(x.timestamp, x.id, x.duration) for x in r.chunks] for r in rows}
        want = {}
        for r in cp.last_n_per_user(seen, 50).orderBy(F.desc("timestamp"), F.desc("id")).collect():
            want.setdefault(r.user_id, []).append((r.timestamp, r.id, r.duration))
        assert latest == want


def test_late_night_alert_comes_at_once_and_once(spark):
    night = 1698534000000 - 2 * HOUR         # 2023-10-28T21:00Z; Berlin turns its clocks back at 01:00Z of the 29th
    s = lambda i, u, t: (i, u, "u", None, 1000, night + t, None)
    batches = [[s(1, 1, 0)], [s(2, 1, 2 * HOUR + MIN)], [s(3, 1, 3 * HOUR)], [s(4, 2, 4 * HOUR), s(5, 1, 4 * HOUR)],
               [s(6, 1, 9 * HOUR - MIN)], [s(7, 1, 20 * HOUR)], [s(8, 1, 27 * HOUR)], [s(9, 1, 28 * HOUR)]]
    got = run(spark, frames_of(spark, batches, SESSION), lambda x: live.late_night_prompt(x, "Europe/Berlin"))
    alerts = [(i, r.user_id, r.night, r.alert_ts - night) for i, b in enumerate(got) for r in b]
    assert alerts == [(1, 1, "2023-10-29", 2 * HOUR + MIN), (3, 2, "2023-10-29", 4 * HOUR), (6, 1, "2023-10-30", 27 * HOUR)]
    data = fx.sessions(spark, SF)
    got = [r for b in run(spark, slices(data, "timestamp", 5), lambda x: live.late_night_prompt(x)) for r in b]
    want = {(r.user_id, r.night) for r in cp.late_night_alerts(data).collect()}
    assert len(got) == len(want) and {(r.user_id, r.night) for r in got} == want


def test_cleanup_stream_equals_batch_without_contained_rows(spark):
    s = fx.sessions(spark, SF).withColumn("timestamp", F.lit(T0) + F.floor((F.col("timestamp") - T0) / 100))
    s = s.withColumn("duration", F.floor(F.col("duration") / 100))
    by = {}
    for r in s.orderBy("timestamp", "id").collect():         # rows that end before an earlier one are left out
        end = by.get((r.user_id, r.url), 0)
        if r.timestamp + r.duration >= end:
            by[r.user_id, r.url] = r.timestamp + r.duration
            by.setdefault("rows", []).append(r)
    kept = spark.createDataFrame(by["rows"], s.schema)
    end = spark.createDataFrame([(-1, -1, "s", None, 1000, 1_800_000_000_000, None)], s.schema)
    got = [r for b in run(spark, [*slices(kept, "timestamp", 3), end], live.cleanup_stream) for r in b if r.user_id >= 0]
    want = mg.cleanup_duplicates(kept).collect()
    key = lambda r: (r.id, r.user_id, r.url, r.title, r.timestamp, r.duration, r.merged_rows)
    assert sorted(map(key, got)) == sorted(map(key, want)) and any(r.merged_rows > 1 for r in want)
    contained = spark.createDataFrame([(i, 1, "u", None, d, T0 + t, None) for i, t, d in ((1, 0, 300_000), (2, 10_000, 1000), (3, 140_000, 1000))], SESSION)
    got = [r for b in run(spark, [contained, end], live.cleanup_stream) for r in b if r.user_id >= 0]
    assert [(r.id, r.merged_rows) for r in got] == [(1, 3)]
    assert sorted((r.id, r.merged_rows) for r in mg.cleanup_duplicates(contained).collect()) == [(1, 2), (3, 1)]


def test_backlog_is_categorised_in_place_once_an_epoch(spark):
    s, c = fx.sessions(spark, SF), fx.categories(spark)
    root = tempfile.mkdtemp(prefix="tt-backlog-")
    path, ledger = f"{root}/sessions", f"{root}/ledger"
    job = live.backlog_batches(c, path, ledger)
    parts = slices(s, "timestamp", 3)
    run(spark, parts, lambda x: x, each=job)
    table = lambda: {r.id: r.category_id for r in spark.read.parquet(path).collect()}
    want = {r.id: r.category_id for r in cg.categorize(s, c).collect()}
    assert table() == want
    runs = sorted(os.listdir(ledger))
    assert runs == ["epoch=0", "epoch=1", "epoch=2"]
    count = lambda e: sorted(tuple(r) for r in spark.read.parquet(f"{ledger}/epoch={e}/begun").collect())
    done = cg.categorize_summary(cg.categorize_backfill(parts[0], c, limit=None)).collect()
    assert count(0) == sorted((r.user_id, r.categorized, r.total) for r in done)
    files = {f: os.stat(f).st_ino for f in glob.glob(f"{path}/date=*/part-*")}
    job(parts[1], 1)                                          # an epoch that comes again
    assert {f: os.stat(f).st_ino for f in glob.glob(f"{path}/date=*/part-*")} == files
    first = count(2)
    shutil.rmtree(f"{ledger}/epoch=2/done")                   # stopped between the table and the ledger
    job(parts[2], 2)
    assert table() == want and count(2) == first and os.path.exists(f"{ledger}/epoch=2/done/_SUCCESS")
