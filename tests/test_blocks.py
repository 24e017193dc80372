"""Blocks of the similarity search against plain Python, on odd vectors and copies."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabtrail.operators import retrieval as rt

META = "struct<title:string,url:string,timestamp:bigint,duration:bigint,category:string>"


def unit(x):
    if x is None or any(a is None for a in x):
        return None
    n = math.sqrt(sum((a * a for a in x), 0.0))
    return [a / n if n else None for a in x]


def score(a, b):
    if a is None or b is None or len(a) != len(b) or any(x is None for x in a + b):
        return None
    return sum((x * y for x, y in zip(a, b)), 0.0)


def place(s, i):
    order = (2, 0.0) if s is None else (0, 0.0) if math.isnan(s) else (1, -s)
    return order, i is not None, i or ""


@pytest.mark.parametrize("block", [7, 10_000])
def test_blocks_give_the_whole_ranking(spark, monkeypatch, block):
    monkeypatch.setattr(rt, "VECTOR_BLOCK", block)
    monkeypatch.setattr(rt, "QUESTION_BLOCK", block)
    rnd = random.Random(5)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(5)]
    vs = [(f"v{i}", vec()) for i in range(60)] + [(f"c{i}", [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(30)]
    vs += [("x", None), (None, vec()), (None, None), ("n", [None, 1.0, 1.0, 1.0, 1.0]), ("z", [0.0] * 5), ("e", []), ("s", [1.0, 2.0]),
           ("t", [math.nan, 1.0, 1.0, 1.0, 1.0]), ("d", [2.0] * 5), ("d", [3.0] * 5)]
    qs = [(i, vec()) for i in range(20)] + [(20, [1.0, 2.0, 3.0, 4.0, 5.0]), (21, None), (22, []), (23, [2.0, 2.0]), (None, vec()), (24, [0.0] * 5)]
    v = spark.createDataFrame([(i, x, ("t", "u", 5, 1, "c")) for i, x in vs], f"id string, values array<double>, metadata {META}")
    q = spark.createDataFrame(qs, "question_id long, query_vec array<double>")
    got = {(r.question_id, r["rank"]): (r.id, r.score) for r in rt.similar_sessions(v, q, k=6).collect()}
    assert len(got) == 6 * len(qs)
    for qid, x in qs:
        best = sorted(((score(unit(y), unit(x)), i) for i, y in vs), key=lambda p: place(*p))[:6]
        mine = [got[qid, r] for r in range(1, 7)]
        assert [i for i, _ in mine] == [i for _, i in best], qid
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12 or a != a and b != b) for (_, a), (b, _) in zip(mine, best))


def test_pairs_are_not_shuffled(spark):
    """A block gives k rows a question: what is sorted and exchanged does not follow vectors times questions."""
    v = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.array(F.rand(1), F.rand(2)).alias("values"),
                                 F.struct(*[F.lit(x).alias(n) for n, x in (("title", "t"), ("url", "u"), ("timestamp", 5), ("duration", 1), ("category", "c"))]).alias("metadata"))
    vv = v.select("id", "metadata", rt._unit(F.col("values")).alias("_v"), F.lit(0).alias("b"))
    q = v.where("id < 50").select(F.col("id").alias("question_id"), rt._unit(F.col("values")).alias("_q"), F.lit(0).alias("b"))
    assert rt.best_in_blocks(vv, q, ["b"], 8).count() == 8 * 50
    p = rt.similar_sessions(v, v.where("id < 50").select(F.col("id").alias("question_id"), F.col("values").alias("query_vec")))
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan


def test_spread_chunks_are_the_chunks(spark, tmp_path, monkeypatch):
    """The same rows, repeated and null keys too, and no part grows with a file's split."""
    from tabtrail.sources import fixtures as fx
    rows = [(i // 2, i % 40 if i % 7 else None, 60.0 + i % 300, f'{{"k": {i}}}') for i in range(4000)] + [(None, 1, None, None)] * 3
    x = spark.createDataFrame(rows, "event_id long, user_id long, value double, props string").select(
        "event_id", F.timestamp_seconds(F.lit(1704067200) + F.coalesce("event_id", F.lit(0)) * 600).cast("timestamp_ntz").alias("ts"),
        "user_id", F.lit("view").alias("event_type"), "value", "props")
    x.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(fx, "SESSIONS_A_PART", 200)
    plain, spread = fx.chunks(spark, str(tmp_path)), fx.spread_chunks(spark, str(tmp_path))
    assert spread.exceptAll(plain).count() == plain.exceptAll(spread).count() == 0 < plain.count()
    assert plain.rdd.getNumPartitions() == 1 and spread.rdd.getNumPartitions() == 21
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < plain.count() / 3


def test_last_n_sorts_spread_chunks(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["last_n_per_user"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
