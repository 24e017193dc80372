"""Operator 11 against brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np

from tabtrail.llm import periodic, queries_runs


def plain_runs(words, least=24, times=3):
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j - i + p >= max(least, times * p):
                found.setdefault((i - p, j), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def numbers(words):
    return np.array([hash(w) for w in words], np.int64)


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    seen = 0
    for _ in range(400):
        words = []
        while len(words) < rnd.choice([10, 23, 24, 25, 60, 200, 500]):
            if rnd.random() < .5:
                words += [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randint(1, 40))]
            else:
                unit = [rnd.randrange(rnd.choice([2, 9])) for _ in range(rnd.randint(1, 50))]
                k = rnd.randint(1, len(unit) * 5)
                words += (unit * 6)[:k]
        want = plain_runs(words)
        assert periodic.find_runs(numbers(words)) == want
        seen += len(want)
    assert seen > 100


def test_every_short_stretch():
    for p in range(1, 40):
        for length in (max(24, 3 * p) - 1, max(24, 3 * p), 3 * p + 30):
            for lead in range(0, 40, 3):
                words = [-1 - i for i in range(lead)] + [i % p for i in range(length)] + [-100 - i for i in range(9)]
                want = [(lead, length, p)] if length >= max(24, 3 * p) else []
                assert periodic.find_runs(np.array(words, np.int64)) == want, (p, length, lead)


def test_hard_words():
    assert periodic.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    thue = np.array([bin(i).count("1") % 2 for i in range(1 << 15)], np.int64)
    assert periodic.find_runs(thue) == []
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic.find_runs(np.array(b, np.int64)) == plain_runs(b)


def digest(words):
    runs = plain_runs(words)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *top, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_on_documents(spark, tmp_path):
    rnd = random.Random(8)
    texts = [None, "", " \t\n", "one", "a " * 50, " x " * 30, "a\x1cb c\n" * 20,
             " ".join(rnd.choice("abc") for _ in range(40_000)), "word " * 30_000]
    texts += ["\n".join(" ".join(rnd.choice(["ein", "two", "três"]) for _ in range(rnd.randint(0, 30)))
                        for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    rows = [(i * 7, t, 1, 2) for i, t in enumerate(texts)] + [(7, "a b " * 40, 1, 2), (None, "a b " * 40, 1, 2)] * 2
    spark.createDataFrame(rows, "doc_id bigint, text string, runs int, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries_runs.op11_periodic_runs(spark, str(tmp_path)).collect()]
    want, planted = [], 0
    for d, t, _, _ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        n, h = len(words), None if d is None else zlib.crc32(str(d).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        want.append((d, *digest(words)) if n < 5000 else (d,))
    assert planted > 5
    order = lambda r: (r[0] is None, r[0] or 0, str(r))
    got.sort(key=order)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=order)):
        assert g[:len(w)] == w
    long = {r[0]: r for r in got if r[0] in (49, 56)}
    assert long[56][2:6] == (0, 30_000, 1, 30_000_000)
    marked = periodic.mark_runs(spark.createDataFrame([(1, "a b " * 12 + "c")], "id int, body string"), id_col="id", text_col="body").first()
    assert (marked.n_words, marked.collapsed) == (25, "a b c") and tuple(marked.runs[0]) == (0, 24, 2)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert periodic.mark_runs(empty).count() == 0
