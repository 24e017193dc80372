import random

import pytest
from pyspark.sql import functions as F

from tabtrail.llm import decontaminate as dc

DOCS = "doc_id bigint, text string, n_words string"
ITEMS = "item_id bigint, text string"


def brute(docs, items, window=10):
    out = {}
    for doc_id, text in docs:
        ws = dc.words(text)
        hit, owners = set(), set()
        for item_id, t in items:
            iw = dc.words(t)
            n = min(window, len(iw))
            for i in range(len(iw) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p:p + n] == iw[i:i + n]:
                        hit.update(range(p, p + n))
                        owners.add(item_id)
        out[doc_id] = (len(ws), len(hit), len(owners), dc.items_digest(owners), bool(hit))
    return out


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["Ünï", "Zoë2"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([3, 9, 10, 14, 25])))) for i in range(12)]
    items += [(50, None), (51, " -- "), (3, "w1, w2; W3")]
    docs = []
    for d in range(40):
        text = rnd.choices(vocab, k=rnd.choice([0, 4, 30, 80]))
        for _ in range(rnd.choice([0, 1, 3])):
            t = rnd.choice(items)[1] or ""
            text[len(text) // 2:len(text) // 2] = t.upper().split()
        docs.append((d, " ".join(text).replace("W1 ", "W1--")))
    docs += [(90, None), (91, ""), (92, " \n "), (93, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_digest_equals_brute_force(spark, data, block_bytes):
    docs, items = data
    got = dc.digest(dc.find_hits(spark.createDataFrame([(*d, "x") for d in docs], DOCS),
                                 spark.createDataFrame(items, ITEMS), block_bytes=block_bytes))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute(docs, items)


def test_both_modes_leave_no_window(spark, data):
    docs, items = data
    df, it = spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    kept = dc.decontaminate(df, it, "documents")
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[4]}
    cut = dc.decontaminate(df, it, "spans").collect()
    assert len(cut) == len(docs)
    assert not any(v[4] for v in brute([(r.doc_id, r.text) for r in cut], items).values())
    clean = {d: t for d, t in docs if not want[d][4]}
    assert {r.doc_id: r.text for r in cut if r.doc_id in clean} == clean


def test_spans_do_not_depend_on_blocks(spark):
    ws = [f"w{i}" for i in range(24)]
    docs = spark.createDataFrame([(1, " ".join(ws))], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", " ".join(ws[:15])), ("b", " ".join(ws[5:21]))], "item_id string, text string")
    for n in (1, 32 << 20):
        assert [r.text for r in dc.decontaminate(docs, items, "spans", block_bytes=n).collect()] == ["w21 w22 w23"]


def test_repeated_items_make_one_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(dc, "WindowSet", lambda items, window: seen.extend(items))
    items = spark.createDataFrame([("a", "x y z")] * 50 + [("b", None)] * 50, "item_id string, text string")
    list(dc.window_blocks(items, "item_id", "text", 10, 5))
    assert seen == [("a", "x y z")]


def test_empty_tables(spark, data):
    docs, items = data
    df, it = spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, ITEMS)
    assert dc.find_hits(df.limit(0), it).count() == 0
    assert dc.find_hits(df, it.limit(0)).where(F.size("spans") > 0).count() == 0
    assert dc.decontaminate(df, it.limit(0)).count() == len(docs)


def test_blocks_leave_no_window_in_either_mode(spark, data):
    docs, items = data
    df, it = spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, ITEMS)
    for mode in ("documents", "spans"):
        one, many = (sorted(dc.decontaminate(df, it, mode, block_bytes=n).collect(), key=str) for n in (1 << 20, 150))
        assert one == many


def test_long_items_come_in_overlapping_pieces(spark, monkeypatch):
    monkeypatch.setattr(dc, "PIECE_WORDS", 7)
    ws = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([("a", " ".join(ws)), ("b", "w1 w2"), ("c", "-")], "item_id string, text string")
    parts = {(r.i, r.t) for r in dc.pieces(items, "item_id", "text", 10).collect()}
    assert parts == {("a", " ".join(ws[a:a + 16])) for a in range(0, 51, 7)} | {("b", "w1 w2")}
    doc = spark.createDataFrame([(1, "x " + " ".join(ws[3:50]) + " y")], "doc_id bigint, text string")
    for n in (1 << 20, 100):
        r = dc.digest(dc.find_hits(doc, items, block_bytes=n)).first()
        assert (r.n_words, r.n_hit, r.n_items) == (49, 47, 1)


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc, "xxh3_64_intdigest", lambda w: 1)
    block = dc.WindowSet([("a", "x y"), ("b", "y x"), ("c", "X-Y"), ("a", "x y")])
    assert block.scan([b"x", b"y"]) == ([(0, 2)], {"a", "c"})
    assert block.scan([b"q", b"y", b"x"]) == ([(1, 3)], {"b"})
    assert block.scan([b"y", b"y"]) == ([], set())


def test_window_of_many_items_and_very_long_text():
    block = dc.WindowSet([(i, "one passage that very many items of a benchmark all share") for i in range(50_000)])
    assert len(block.windows[10].hashes) == 2 and block.scan(dc.words("so one passage"))[0] == []
    text = "fill " * 300_000 + "One passage, that very many items of a benchmark all share." + " more" * 300_000
    spans, owners = block.scan(dc.words(text))
    assert spans == [(300_000, 300_011)] and len(owners) == 50_000
