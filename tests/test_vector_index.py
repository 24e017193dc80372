"""The inverted-list index against the exact search."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tabtrail.operators import retrieval as rt
from tabtrail.operators import vector_index as vi
from tabtrail.sources import fixtures as fx

META = "struct<title:string,url:string,timestamp:bigint,duration:bigint,category:string,user_id:bigint>"


def folder():
    return tempfile.mkdtemp(prefix="tt-index-") + "/ix"


def ranked(df):
    return [(r.question_id, r["rank"], r.id, round(r.score, 9)) for r in df.orderBy("question_id", "rank").collect()]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_given_vectors(spark, sf):
    d = f"/root/testdata/sf{sf}"
    v, q = fx.session_vectors(spark, d).cache(), fx.question_vectors(spark, d)
    model = vi.fit(v)
    index = vi.build(v, model, folder())
    assert index.count() == v.count() and model.probes < len(model.directions)
    want = ranked(rt.similar_sessions(v, q))
    got = ranked(vi.search(index, model, q))
    assert len(got) == len(want)
    recall = len({(a, i) for a, _, i, _ in got} & {(a, i) for a, _, i, _ in want}) / len(want)
    assert recall >= 0.9, recall
    assert ranked(vi.search(index, model, q, exact=True)) == want
    assert ranked(vi.search(index, model, q, probes=1, exact=True)) == want
    start = 1705276800000
    assert ranked(vi.search(index, model, q, start=start, exact=True)) == ranked(rt.similar_sessions(v, q, start=start))


def clustered(spark, n, copies=0):
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(str(i), [c + rnd.gauss(0, .15) for c in centres[i % 40]]) for i in range(n)]
    rows += [(f"copy{i}", centres[0]) for i in range(copies)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, x, ("t", "u", 5, 1, "c", 1)) for i, x in rows], f"id string, values array<float>, metadata {META}")


def test_clusters_need_few_probes_and_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(vi, "PART_ROWS", 100)
    rows = clustered(spark, 1200, copies=800)
    v = frame(spark, rows)
    model = vi.fit(v, 5)
    assert model.probes <= 4 < len(model.directions)
    index = vi.build(v, model, folder())
    assert max(model.sizes.values()) >= 800
    q = spark.createDataFrame([(i, rows[i * 7][1]) for i in range(30)], "question_id long, query_vec array<float>")
    want = ranked(rt.similar_sessions(v, q, 5))
    assert ranked(vi.search(index, model, q, 5, exact=True)) == want
    got = ranked(vi.search(index, model, q, 5))
    assert len(set(got) & set(want)) >= .9 * len(want)
    lists = model.lists(spark)
    parts = index.join(lists, "list").groupBy("list", F.pmod(F.xxhash64("id"), "parts").alias("p")).count()
    assert parts.agg(F.max("count")).first()[0] < 200      # the copies' list too


def test_vectors_without_direction_and_small_tables(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [math.nan, 1.0]), ("e", [0.0, 2.0]),
            ("f", []), ("g", [1.0, 1.0, 1.0]), ("h", [None, 1.0]), ("i", [-3.0, -3.0])]
    v = frame(spark, rows)
    model = vi.fit(v)
    index = vi.build(v, model, folder())
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "question_id long, query_vec array<float>")
    got = ranked(vi.search(index, model, q, 8, exact=True))
    assert [(a, i) for a, _, i, _ in got] == [(1, "a"), (1, "a"), (1, "e"), (1, "i")]
    none = v.limit(0)
    model = vi.fit(none)
    assert vi.search(vi.build(none, model, folder()), model, q).count() == 0


def test_search_reads_the_probed_lists_only(spark):
    v = frame(spark, clustered(spark, 600))
    model = vi.fit(v, 5, lists=24)
    index = vi.build(v, model, folder())
    q = spark.createDataFrame([(1, clustered(spark, 1)[0][1])], "question_id long, query_vec array<float>")
    plan = vi.search(index, model, q, 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
