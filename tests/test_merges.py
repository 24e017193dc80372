"""Merge rules: literal cases (FIXTURES.md section 4), brute-force references for all
three rules (plain Python restatements of the rules, written independently of the
operators), and the hot-key split path against the plain path."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tabtrail.operators import merge as mg

SCHEMA = "id long, user_id long, url string, title string, timestamp long, duration long"


def frame(spark, rows):
    data = [(i, r[3] if len(r) > 3 else 1, r[2] if len(r) > 2 else "u", r[4] if len(r) > 4 else "t",
             r[0], r[1]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def out(df, cols=("timestamp", "duration")):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- references
def ref_ingest(rows, lookback=120000, gap=35000):
    """The stateful rule as a table of rows (id, url, ts, dur), processed in order."""
    table = []
    for cid, (ts, dur, url) in enumerate(rows):
        look = [r for r in table if r["url"] == url and r["ts"] >= ts - lookback]
        if look:
            orig = sorted(look, key=lambda r: (r["ts"], r["id"]))[0]
            if ts - (orig["ts"] + orig["dur"]) <= gap:
                orig["dur"] += dur
                table = [r for r in table if not (r in look and r is not orig)]
                continue
        table.append({"id": cid, "url": url, "ts": ts, "dur": dur})
    return sorted((r["ts"], r["dur"]) for r in table)


def ref_cleanup(rows, gap=120000):
    by_url = {}
    for i, (ts, dur, url) in enumerate(rows):
        by_url.setdefault(url, []).append((ts, i, dur))
    res = []
    for url, items in by_url.items():
        items.sort()
        group = [items[0]]
        for it in items[1:]:
            prev = group[-1]
            if it[0] - (prev[0] + prev[2]) <= gap:
                group.append(it)
            else:
                res.append((group[0][0], sum(g[2] for g in group)))
                group = [it]
        res.append((group[0][0], sum(g[2] for g in group)))
    return sorted(res)


def ref_display(rows, window=300000):
    items = sorted((ts, i, dur, url, title) for i, (ts, dur, url, title) in enumerate(rows))
    res, group = [], [items[0]]
    for it in items[1:]:
        last = group[-1]
        if it[3] == last[3] and it[4] == last[4] and it[0] - last[0] <= window:
            group.append(it)
        else:
            res.append((group[0][0], sum(g[2] for g in group), len(group) if len(group) > 1 else None))
            group = [it]
    res.append((group[0][0], sum(g[2] for g in group), len(group) if len(group) > 1 else None))
    return sorted(res, key=lambda t: (t[0], t[1]))


# ---------------------------------------------------------------- literal cases
def test_ingest_lost_time(spark):
    df = frame(spark, [(0, 10000), (60000, 30000), (95000, 10000), (121000, 5000)])
    assert out(mg.ingest_merge(df)) == [(0, 10000), (60000, 35000)]
    lossless = mg.ingest_merge(df, mode="lossless")
    assert sum(d for _, d in out(lossless)) == 55000


def test_ingest_long_visit(spark):
    df = frame(spark, [(30000 * i, 30000) for i in range(20)])
    assert out(mg.ingest_merge(df)) == [(0, 150000), (150000, 150000), (300000, 150000),
                                        (450000, 150000)]


def test_ingest_gap_edge(spark):
    assert out(mg.ingest_merge(frame(spark, [(0, 10000), (45000, 5000)]))) == [(0, 15000)]
    assert len(out(mg.ingest_merge(frame(spark, [(0, 10000), (45001, 5000)])))) == 2


def test_cleanup_edges(spark):
    assert out(mg.cleanup_duplicates(frame(spark, [(0, 10000), (130000, 5000)]))) == [(0, 15000)]
    assert len(out(mg.cleanup_duplicates(frame(spark, [(0, 10000), (130001, 5000)])))) == 2
    got = out(mg.cleanup_duplicates(frame(spark, [(0, 300000), (10000, 1000), (140000, 1000)])))
    assert got == [(0, 301000), (140000, 1000)]


def test_display_cases(spark):
    same = [(0, 1000, "https://a.com/x?q=1", 1, "T"), (300000, 1000, "https://a.com/x#f", 1, "T")]
    assert len(out(mg.display_merge(frame(spark, same)))) == 1
    far = [(0, 1000, "https://a.com/x", 1, "T"), (300001, 1000, "https://a.com/x", 1, "T")]
    assert len(out(mg.display_merge(frame(spark, far)))) == 2
    inter = [(0, 1000, "https://a.com", 1, "A"), (20000, 1000, "https://b.com", 1, "B"),
             (40000, 1000, "https://a.com", 1, "A")]
    assert len(out(mg.display_merge(frame(spark, inter)))) == 3
    nulls = [(0, 1000, "https://a.com", 1, None), (30000, 1000, "https://a.com", 1, None)]
    r = mg.display_merge(frame(spark, nulls)).collect()
    assert len(r) == 1 and r[0]["merged_count"] == 2 and r[0]["duration"] == 2000


# ---------------------------------------------------------------- properties
# Each hypothesis example is a batch of random sequences, one per user, run as one job.
seq_st = st.lists(st.tuples(st.integers(0, 200000), st.integers(1000, 60000),
                            st.sampled_from(["a", "b"])), min_size=1, max_size=25)


def in_order(raw):
    ts, rows = 0, []
    for gap, dur, url in raw:
        ts += gap
        rows.append((ts, dur, url))
    return rows


def batch_frame(spark, seqs):
    data, i = [], 0
    for user, rows in enumerate(seqs):
        for r in rows:
            t, d, u = r[0], r[1], r[2]
            title = r[3] if len(r) > 3 else "t"
            data.append((i, user, u, title, t, d))
            i += 1
    return spark.createDataFrame(data, SCHEMA)


def per_user(df, cols):
    res = {}
    for r in df.collect():
        res.setdefault(r["user_id"], []).append(tuple(r[c] for c in cols))
    return {k: sorted(v, key=lambda t: (t[0], t[1])) for k, v in res.items()}


@settings(max_examples=3, deadline=None)
@given(st.lists(seq_st, min_size=10, max_size=30))
def test_ingest_matches_reference(spark, raws):
    seqs = [in_order(r) for r in raws]
    got = per_user(mg.ingest_merge(batch_frame(spark, seqs)), ("timestamp", "duration"))
    for user, rows in enumerate(seqs):
        assert got[user] == ref_ingest(rows)


@settings(max_examples=3, deadline=None)
@given(st.lists(seq_st, min_size=10, max_size=30))
def test_cleanup_matches_reference_and_split(spark, raws):
    seqs = [in_order(r) for r in raws]
    df = batch_frame(spark, seqs)
    plain = per_user(mg.cleanup_duplicates(df), ("timestamp", "duration"))
    split = per_user(mg.cleanup_duplicates(df, split_ms=60000), ("timestamp", "duration"))
    for user, rows in enumerate(seqs):
        assert plain[user] == ref_cleanup(rows) == split[user]
        assert sum(d for _, d in plain[user]) == sum(d for _, d, _ in rows)


disp_st = st.lists(st.tuples(st.integers(0, 400000), st.integers(1000, 60000),
                             st.sampled_from(["https://a.com/x", "https://a.com/x?y", "https://b.com"]),
                             st.sampled_from(["A", "B", None])), min_size=1, max_size=25)


@settings(max_examples=3, deadline=None)
@given(st.lists(disp_st, min_size=10, max_size=30))
def test_display_matches_reference_and_split(spark, raws):
    seqs = []
    for raw in raws:
        ts, rows = 0, []
        for gap, dur, url, title in raw:
            ts += gap
            rows.append((ts, dur, url, title))
        seqs.append(rows)
    df = batch_frame(spark, seqs)
    cols = ("timestamp", "duration", "merged_count")
    plain = per_user(mg.display_merge(df), cols)
    split = per_user(mg.display_merge(df, split_ms=60000), cols)
    for user, rows in enumerate(seqs):
        norm = [(t, d, u.split("?")[0], ti) for t, d, u, ti in rows]
        assert plain[user] == ref_display(norm) == split[user]


def test_split_equals_plain_on_fixture(spark):
    from tabtrail.sources import fixtures as fx
    c = fx.chunks(spark, "/root/testdata/sf0.001", url_variant=True)
    cols = ("id", "timestamp", "duration", "merged_count")
    assert out(mg.display_merge(c, split_ms=None), cols) == out(mg.display_merge(c, split_ms=3600000), cols)
    c2 = fx.chunks(spark, "/root/testdata/sf0.001")
    cols = ("id", "timestamp", "duration", "merged_chunks")
    assert out(mg.ingest_merge(c2, split_ms=None), cols) == out(mg.ingest_merge(c2, split_ms=3600000), cols)


def test_history_positions_equal_a_plain_rank(spark):
    from tabtrail.operators import stats as stt
    from tabtrail.sources import fixtures as fx
    m = mg.display_merge(fx.chunks(spark, "/root/testdata/sf0.001", url_variant=True)).cache()
    rows = m.collect()
    for field, order in [("recency", "desc"), ("duration", "desc"), ("duration", "asc")]:
        col = "timestamp" if field == "recency" else "duration"
        sign = -1 if order == "desc" else 1
        want, place = [], {}
        for r in sorted(rows, key=lambda r: (r.user_id, sign * (r[col] or 0), r.timestamp, r.id)):
            place[r.user_id] = place.get(r.user_id, 0) + 1
            want.append((r.id, place[r.user_id]))
        assert out(stt.history_view(m, None, field, order), ("id", "position")) == sorted(want), (field, order)


def test_history_title_falls_back_to_the_domain(spark):
    from tabtrail.operators import stats as stt
    df = spark.createDataFrame([(1, 1, "https://a.example/x", "", 5, 1), (2, 1, "https://b.example/", None, 6, 1),
                                (3, 1, "https://c.example/", "Shown", 7, 1)], SCHEMA)
    assert out(stt.history_view(df), ("id", "shown_title")) == [(1, "a.example"), (2, "b.example"), (3, "Shown")]
