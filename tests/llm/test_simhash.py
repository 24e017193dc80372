import random

import pytest
import xxhash

from tabtrail.llm import simhash as sh
from tabtrail.llm.components import components


def plain_fingerprint(text):
    """Definition, bit by bit."""
    ws = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).translate(
        {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not ws:
        return 0
    n = min(3, len(ws))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + n]).encode(), 42) for i in range(len(ws) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, bits):
    """Smallest member reachable, by brute force."""
    low = {}
    for f in sorted(fps):
        if f in low:
            continue
        todo = [f]
        low[f] = f
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in low and bin((x ^ y) & (1 << 64) - 1).count("1") <= bits:
                    low[y] = f
                    todo.append(y)
    return low


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_equals_definition():
    rnd = random.Random(1)
    vocab = ["a", "Bé", "ÀB", "c d", "x-y", "zz"]
    texts = [None, "", " \n", "One", "one two", "Ä\x0bb\tc"] + [
        rnd.choice([" ", "\n", "  \t"]).join(rnd.choices(vocab, k=k)) for k in (1, 2, 3, 4, 50, 400)]
    assert [sh.fingerprint(t) & (1 << 64) - 1 for t in texts] == [plain_fingerprint(t) for t in texts]


def test_position_sets_meet_every_guaranteed_match():
    from itertools import combinations
    for k in range(8):
        sets = [set(s) for s in sh.position_sets(k)]
        for shared in combinations(range(8), 8 - k):
            assert any(s <= set(shared) for s in sets)


@pytest.mark.parametrize("bits,list_rows", [(3, 1 << 16), (3, 8), (1, 1 << 16), (5, 8)])
def test_components_equal_brute_force(spark, bits, list_rows):
    rnd = random.Random(7)
    fps = {0}
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(25):                                     # chains of near fingerprints
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = {signed(x) for x in fps}
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    got = {r.node: r.root for r in components(sh.link_edges(df, bits, list_rows)).collect()}
    want = plain_components(fps, bits)
    assert {f: got.get(f, f) for f in fps} == want


DOC = "doc_id bigint, text string, fp string, root int"


def docs_of(spark):
    rnd = random.Random(3)
    base = " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randint(0, 900)) for _ in range(300))
    near = base.replace(base.split()[10], "changed", 1)
    rows = [(5, base), (9, base), (7, near), (1, "other words entirely here"), (None, "lonely text here now"),
            (20, None), (21, ""), (22, " \n"), (30, base), (30, "a quite different text"), (31, "twice"), (31, "twice"),
            (None, base)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOC), rows


def test_groups_and_kept_rows(spark):
    df, rows = docs_of(spark)
    got = sorted((str(r.doc_id), r.fp, r.component_id) for r in sh.near_duplicates(df).collect())
    fps = {signed(plain_fingerprint(t)) for _, t in rows}
    low = plain_components(fps, 3)
    group = lambda t: low[signed(plain_fingerprint(t))]
    ids = {}
    for d, t in rows:
        if d is not None:
            ids[group(t)] = min(ids.get(group(t), d), d)
    assert got == sorted((str(d), signed(plain_fingerprint(t)), ids.get(group(t))) for d, t in rows)
    kept = sh.keep_one(df)
    assert kept.columns == df.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == len({group(t) for _, t in rows})
    assert {group(t) for _, t in left} == {group(t) for _, t in rows}
    assert all(ids.get(group(t)) == d for d, t in left)


def test_empty_table(spark):
    df, _ = docs_of(spark)
    assert sh.near_duplicates(df.limit(0)).count() == 0
    assert sh.keep_one(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    rnd = random.Random(4)
    long = " ".join(f"W{rnd.randint(0, 9999)}" for _ in range(60_000))
    rows = [(7, long), (3, long.lower()), (9, "x" * 500_000), (11, None)]
    got = {r.doc_id: (r.fp, r.component_id) for r in sh.near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: signed(plain_fingerprint(t)) for i, t in rows}
    assert {i: c for i, (_, c) in got.items()} == {7: 3, 3: 3, 9: 9, 11: 11}
