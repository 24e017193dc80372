"""Session text, similarity top-k, reflection context text, cache plan."""

from pyspark.sql import functions as F

from tabtrail.operators import retrieval as rt
from tabtrail.sources.tables import seed_categories

S = "id long, user_id long, url string, title string, duration long, timestamp long, category_id long"


def test_session_text(spark):
    df = spark.createDataFrame([("T", "https://a", 90000, "Learning", 1704067207179),
                                (None, "https://b", 0, None, 0)],
                               "title string, url string, d long, c string, ts long")
    got = [r[0] for r in df.select(rt.session_text(F.col("title"), F.col("url"), F.col("d"),
                                                   F.col("c"), F.col("ts"))).collect()]
    assert got[0] == ("Browsing session\nTitle: T\nURL: https://a\nDurationMinutes: 2\n"
                      "Category: Learning\nTimestamp: 2024-01-01T00:00:07.179Z")
    assert got[1] == "Browsing session\nURL: https://b\nDurationMinutes: 0"


def test_similar_sessions_exact(spark):
    import math
    vecs = [("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0]), ("d", [1.0, 0.1])]
    v = spark.createDataFrame(
        [(i, [float(x) for x in vec], (None, "u", 10, 0, "X", "browser_session", 1))
         for i, vec in vecs],
        "id string, values array<float>, metadata struct<title:string,url:string,timestamp:long,"
        "duration:long,category:string,source:string,user_id:long>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "question_id long, query_vec array<float>")
    got = [(r.id, round(r.score, 6)) for r in rt.similar_sessions(v, q, k=2).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("d", round(1 / math.sqrt(1.01), 6))]
    qu = spark.createDataFrame([(7, 1, [0.0, 1.0])], "question_id long, user_id long, query_vec array<float>")
    got = [r.id for r in rt.similar_sessions(v, qu, k=1, per_user=True).collect()]
    assert got == ["c"]


def test_context_text(spark):
    c = seed_categories(spark)
    s = spark.createDataFrame([(1, 1, "https://a", "A", 120000, 3000, 2),
                               (2, 1, "https://b", None, 60000, 2000, 2),
                               (3, 1, "https://c", "C", 30000, 1000, None)], S)
    users = s.select("user_id").union(spark.createDataFrame([(2,)], "user_id long"))
    stats = rt.context_stats(rt.context_rows(s, c, None))
    ctx = {r.user_id: r.context for r in rt.reflection_context(users, stats).collect()}
    assert ctx[2] == "No browsing activity found for this time period."
    assert ctx[1] == ("Total sessions: 3\n\nTime by category:\n"
                      "- Learning: 3 minutes (2 sessions)\n  Top sites:\n"
                      "    • A (2m)\n    • https://b (1m)\n"
                      "- Uncategorized: 1 minutes (1 sessions)\n  Top sites:\n    • C (1m)\n")


def test_generate_answers_and_context_json(spark):
    ctx = spark.createDataFrame([(1, 2, "ctx text")], "user_id long, total_sessions long, context string")
    qs = spark.createDataFrame([(1, 10, "why?")], "user_id long, question_id long, query string")
    assert rt.generate_answers(ctx, qs).first().answer == "ctx text"
    gen = rt.generate_answers(ctx, qs, lambda q, c: q + " | " + c.str.upper())
    assert gen.first().answer == "why? | CTX TEXT"
    js = ctx.select(F.to_json(F.struct("total_sessions", "context")).alias("j"))
    assert js.select(rt.parse_context(F.col("j"))["total_sessions"]).first()[0] == 2
