"""One failing row of a hundred costs one result, not its batch."""

import pandas as pd
from pyspark.sql import functions as F

from tabtrail.operators import categorize as cz, retrieval as rt
from tabtrail.operators.embed import embed_sessions
from tabtrail.sources.tables import seed_categories


def sessions(spark, n=100):
    return spark.createDataFrame(
        [(i, 1, f"https://site{i}.example/", "bad" if i == 7 else f"t{i}", 1000, 1704067200000 + i, None) for i in range(n)],
        "id long, user_id long, url string, title string, duration long, timestamp long, category_id long")


def test_classifier(spark):
    def classify(pdf):
        if (pdf["title"] == "bad").any():
            raise ValueError("cannot")
        return pd.Series(["Research"] * len(pdf))
    c = seed_categories(spark)
    ids = {r.name: r.id for r in c.collect()}
    got = {r.id: r.category_id for r in cz.categorize(sessions(spark), c, classify).collect()}
    assert got == {i: ids["Uncategorized" if i == 7 else "Research"] for i in range(100)}


def test_embedder(spark):
    def embed(texts):
        if texts.str.contains("Title: bad").any():
            raise ValueError("cannot")
        return pd.Series([[1.0, 0.0]] * len(texts))
    assert {int(r.id) for r in embed_sessions(sessions(spark), embed).collect()} == set(range(100)) - {7}


def test_generator(spark):
    def answer(query, context):
        if (query == "bad").any():
            raise ValueError("cannot")
        return query + "!"
    q = sessions(spark).select("user_id", F.col("id").alias("question_id"), F.col("title").alias("query"))
    ctx = spark.createDataFrame([(1, "c")], "user_id long, context string")
    got = {r.question_id: r.answer for r in rt.generate_answers(ctx, q, answer).collect()}
    assert got == {i: None if i == 7 else f"t{i}!" for i in range(100)}


def test_many_global_questions(spark):
    import math
    import random
    rnd = random.Random(3)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(4)]
    vs, qs = [(str(i), vec()) for i in range(30)], [(i, vec()) for i in range(1500)]
    v = spark.createDataFrame(vs, "id string, values array<double>").withColumn("metadata", F.struct(
        F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit(5).cast("long").alias("timestamp"),
        F.lit(1).cast("long").alias("duration"), F.lit("c").alias("category")))
    got = {(r.question_id, r["rank"]): r.id for r in rt.similar_sessions(
        v, spark.createDataFrame(qs, "question_id long, query_vec array<double>"), k=2).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for qid, q in qs:
        best = sorted(vs, key=lambda x: (-dot(x[1], q) / math.sqrt(dot(x[1], x[1]) * dot(q, q)), x[0]))[:2]
        assert [got[qid, 1], got[qid, 2]] == [b[0] for b in best]


def test_vector_keys(spark):
    df = spark.createDataFrame([(1, "u", 5), (None, "u", 5)], "id long, url string, timestamp long")
    assert [r[0] for r in df.select(rt.vector_id(F.col("id"), F.col("url"), F.col("timestamp"))).collect()] == ["1", "u-5"]


def test_chunk_ids_of_long_sessions_are_unique(spark):
    from tabtrail.operators import capture as cp
    rows = [(1, 1, "u", "t", 0, 0, 9 * 3_600_000, 9 * 3_600_000, 9 * 3_600_000, "activated"),
            (1, 2, "u", "t", 0, 0, 3_600_000, 3_600_000, 3_600_000, "activated")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, url string, title string, tab_id long, start_ts long, "
                                     "end_ts long, elapsed_ms long, duration long, end_kind string")
    ids = [r.id for r in cp.session_chunks(df).collect()]
    assert len(ids) == len(set(ids)) == 1200
