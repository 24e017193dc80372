"""Operator 13 against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from tabtrail.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, min_docs, min_chars, keep):
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in found.items() if n >= min_docs and len(k) >= max(1, min_chars)}
    first = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} & gone:
            if k not in first or d is not None and (first[k] is None or d < first[k]):
                first[k] = d
    out = []
    for d, t in rows:
        lines, kept, seen = (t or "").split("\n"), [], set()
        for x in lines:
            k = key(x)
            if k not in gone or keep == "first" and first[k] == d and k not in seen:
                kept.append(x)
            seen.add(k)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs,min_chars,keep", [(10, 1, "none"), (2, 1, "first"), (3, 5, "none"), (4, 1, "first")])
def test_lines_equal_plain_python(spark, min_docs, min_chars, keep):
    rnd = random.Random(min_docs)
    pool = ["Common line", " common LINE\t", "ÄÖ ü", "äö ü", "x", "", "  ", "\x1cx", "\xa0x", "tail\r", "long " * 3000]
    pool += [f"line {i}" for i in range(40)]
    rows = [(i, "\n".join(rnd.choice(pool + [f"own {rnd.random()}"] * 9) for _ in range(rnd.randint(0, 12)))) for i in range(200)]
    rows += [(300 + i, None) for i in range(12)] + [(None, "null id\nCommon line\nnull id")] * 12 + [(5, "same\nsame")] * 11
    rows += [(400, "\n" * 500 + "Common line\n" * 500), (401, "word " * 60_000)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, n_lines int, `__text` string").repartition(7)
    want = plain(rows, min_docs, min_chars, keep)
    for most in (ld.MOST_BYTES, 0):        # confirmed keys broadcast, or joined
        got = ld.dedup_lines(df, min_docs=min_docs, min_chars=min_chars, keep=keep, most_bytes=most).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(w[2] for w in want) > 300
    for most in (ld.MOST_BYTES, -1):
        assert ld.dedup_lines(df.limit(0), most_bytes=most).count() == 0


def test_filters_hold_every_repeat():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    tasks = [np.concatenate([h[i * 2000:(i + 1) * 2000], h[:50] if i in (3, 8) else h[:0]]) for i in range(10)]
    tasks[5] = np.concatenate([tasks[5], tasks[5][:70]])
    merged = ld.Filters(1 << 14)
    for t in tasks:
        own = ld.Filters(1 << 14)
        for part in np.array_split(t, 3):
            own.add(part)
        merged.merge(own.once, own.twice)
    assert ld.passes(merged.twice, h[:50]).all() and ld.passes(merged.twice, tasks[5][:70]).all()
    assert ld.passes(merged.twice, h[12_000:]).mean() < .1
    full = ld.Filters(1)                # a full filter suspects everything
    full.add(h)
    full.add(h)
    assert ld.passes(full.twice, h).all()
    assert [ld.filter_words(n) for n in (0, 10_000_000, 10 ** 12)] == [1 << 14, 1 << 22, 1 << 23]
