"""Tab-event state machine, chunking and alert operators."""

from tabtrail.operators import capture as cp

E = "event_id long, user_id long, ts_ms long, kind string, tab_id long, url string, title string"


def events(spark, rows):
    return spark.createDataFrame([(i, 1, t, k, 1, u, "T") for i, (t, k, u) in enumerate(rows)], E)


def test_state_machine(spark):
    ev = events(spark, [
        (0, "activated", "https://a.com"),
        (45000, "url_updated", "https://a.com"),      # same URL: no-op
        (65000, "url_updated", "https://b.com"),      # ends a (65 s), starts b
        (100000, "focus_gained", "chrome://x"),       # internal focus gain: no-op
        (170000, "focus_gained", "https://c.com"),    # replaces b: 70 s -> 60 s kept
        (171000, "focus_lost", "https://c.com"),      # c lasted 1 s -> below 3 s
        (200000, "activated", "http://localhost:3000"),  # internal: no session
        (260000, "activated", "https://d.com"),       # open at the end
    ])
    got = [(r.url, r.start_ts, r.elapsed_ms, r.duration, r.end_kind)
           for r in cp.tab_sessions(ev).orderBy("start_ts").collect()]
    assert got == [("https://a.com", 0, 65000, 65000, "url_updated"),
                   ("https://b.com", 65000, 105000, 90000, "focus_gained"),
                   ("https://c.com", 170000, 1000, 0, "focus_lost")]
    cur = cp.current_session(ev, 320000).collect()
    assert [(r.url, r.elapsed_ms, r.elapsed_text) for r in cur] == [("https://d.com", 60000, "1:00")]


def test_chunks_min_duration(spark):
    ev = events(spark, [(0, "activated", "https://a.com"), (32999, "focus_lost", "x"),
                        (40000, "activated", "https://a.com"), (73000, "focus_lost", "x")])
    ch = cp.session_chunks(cp.tab_sessions(ev)).orderBy("timestamp").collect()
    assert [(r.timestamp, r.duration) for r in ch] == [(0, 30000), (40000, 30000), (70000, 3000)]


def test_alerts(spark):
    s = spark.createDataFrame([(1, 1, 3600000 * 2, 1000), (2, 1, 3600000 * 3, 1000),
                               (3, 1, 3600000 * 9, 3600000 * 2 + 5)],
                              "id long, user_id long, timestamp long, duration long")
    late = cp.late_night_alerts(s).collect()
    assert [(r.night, r.alert_ts, r.late_sessions) for r in late] == [("1970-01-01", 7200000, 2)]
    brk = cp.break_alerts(s).orderBy("alert_ts").collect()
    assert [r.alert_no for r in brk] == list(range(1, 10))


def test_split_path_equals_plain(spark):
    from tabtrail.sources import fixtures as fx
    ev = fx.tab_events(spark, "/root/testdata/sf0.001")

    def k(df, cols):
        return sorted(tuple(r[c] for c in cols) for r in df.collect())
    cols = ("user_id", "event_id", "start_ts", "end_ts", "duration", "end_kind")
    # ten-minute buckets: sessions and gaps cross bucket edges often
    assert k(cp.tab_sessions(ev, split_ms=None), cols) == k(cp.tab_sessions(ev, split_ms=600000), cols)
    cols = ("user_id", "start_ts", "elapsed_ms")
    assert k(cp.current_session(ev, 1706659200000, split_ms=None), cols) == \
        k(cp.current_session(ev, 1706659200000, split_ms=600000), cols)
    cols = ("user_id", "idle_start", "idle_ms", "resumed_by")
    assert k(cp.idle_spells(ev, 60000, split_ms=None), cols) == \
        k(cp.idle_spells(ev, 60000, split_ms=600000), cols)
