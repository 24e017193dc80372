"""Statistics and wellness: score and ratio literal cases, runs, listings, named ranges."""

from pyspark.sql import functions as F

from tabtrail.operators import stats as st
from tabtrail.sources.tables import seed_categories

S = "id long, user_id long, url string, title string, duration long, timestamp long, category_id long"


def sessions(spark, rows):
    return spark.createDataFrame([(i, 1, "https://a.com", "t", d, 1000 * i, c)
                                  for i, (c, d) in enumerate(rows)], S)


def score(spark, mix):
    c = seed_categories(spark)
    return st.wellness_daily(sessions(spark, mix), c).first()["score"]


def test_scores(spark):
    # ids: 1 Focused Work, 2 Learning, 5 Relaxation, 4 Social, 6 Mindless, 8 Uncategorized
    assert score(spark, [(1, 35), (2, 25), (5, 25), (4, 15)]) == 100
    assert score(spark, [(1, 30), (2, 20), (5, 20), (4, 10), (6, 20)]) == 74
    assert score(spark, [(8, 10)]) == 0
    assert score(spark, [(None, 10)]) == 0
    assert score(spark, [(5, 10)]) == 0
    assert score(spark, [(5, 0)]) == 0


def test_labels_and_ratio(spark):
    c = seed_categories(spark)
    r = st.focus_rest_ratio(sessions(spark, [(1, 3), (5, 2)]), c).first()
    assert r["ratio"] == "1.50"
    assert st.focus_rest_ratio(sessions(spark, [(1, 5)]), c).first()["ratio"] == "Infinity"
    assert st.focus_rest_ratio(sessions(spark, [(6, 5)]), c).first()["ratio"] == "0:0"
    df = spark.createDataFrame([(75,), (50,), (49,)], "s long")
    assert [x[0] for x in df.select(st.score_label(F.col("s"))).collect()] == \
        ["Great balance!", "Room for improvement", "Consider rebalancing"]


def test_category_runs(spark):
    c = seed_categories(spark)
    # A A B A null null -> A, B, A, Uncategorized
    runs = st.category_runs(sessions(spark, [(1, 1), (1, 1), (2, 1), (1, 1), (None, 1), (None, 1)]), c)
    assert runs.first()["session_count"] == 4


def test_listing_and_lookup(spark):
    c = seed_categories(spark)
    s = sessions(spark, [(1, 10)] * 5 + [(None, 10)])
    top = st.list_sessions(s, c, limit=3).collect()
    assert [r["id"] for r in top] and sorted(r["id"] for r in top) == [3, 4, 5]
    assert {r["category_name"] for r in top} == {"Focused Work", None}
    assert st.session_by_id(s, c, 99).count() == 0


def test_range_start():
    now = 1706659200000 + 5 * 3600000
    assert st.range_start("today", now, "UTC") == 1706659200000
    assert st.range_start("week", now) == now - 7 * 86400000
    assert st.range_start("other", now) == now - 86400000
    assert st.range_start("today", now, "America/New_York") == 1706677200000


def test_activity_summary_top_and_share(spark):
    c = seed_categories(spark)
    s = sessions(spark, [(1, 60000), (2, 60000), (5, 180000)])
    rows = {r["name"]: r for r in st.activity_summary(s, c).collect()}
    assert rows["Relaxation"]["percentage"] == "60.0"
    assert rows["Focused Work"]["top_category"] == "Relaxation"
    assert rows["Focused Work"]["time_text"] == "1m"
    lines = st.activity_lines(st.activity_summary(s, c)).first()["lines"]
    assert lines.splitlines()[0] == "- Relaxation: 3m (60.0%) - 1 sessions - Type: rest"


def ref_score(mix):
    """Plain restatement: shares of productive/growth/rest/social vs ideal, drain x30."""
    kind = {1: "productive", 7: "productive", 2: "growth", 3: "growth", 4: "social",
            5: "rest", 6: "drain"}
    total = sum(d for _, d in mix)
    if total == 0:
        return 0
    t = {}
    for c, d in mix:
        k = kind.get(c, "unknown")
        t[k] = t.get(k, 0) + d
    score = 100.0
    for k, ideal in (("productive", 0.35), ("growth", 0.25), ("rest", 0.25), ("social", 0.15)):
        score -= abs(ideal - t.get(k, 0) / total) * 100
    score -= (t.get("drain", 0) / total) * 30
    import math
    return max(0, min(100, math.floor(score + 0.5)))


def test_score_property(spark):
    import random
    rnd = random.Random(7)
    mixes = [[(rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, None]), rnd.randint(0, 900000))
              for _ in range(rnd.randint(1, 12))] for _ in range(300)]
    data = [(u * 100 + j, u, "https://a.com", "t", d, 1000 * j, c)
            for u, mix in enumerate(mixes) for j, (c, d) in enumerate(mix)]
    s = spark.createDataFrame(data, S)
    got = {r.user_id: r.score for r in st.wellness_daily(s, seed_categories(spark)).collect()}
    for u, mix in enumerate(mixes):
        assert got[u] == ref_score(mix), (u, mix)
        assert 0 <= got[u] <= 100


def test_positions_of_equal_values_are_spread_over_tasks(spark):
    """A user whose rows all last 30 s: every task gets about its share, and positions are right."""
    from pyspark.sql import functions as F
    from tabtrail.operators import stats as st
    from tabtrail.operators.ordered import with_rank
    rows = spark.range(20_000).select(
        F.col("id"), F.when(F.col("id") % 10 < 9, 1).otherwise(F.lit(None)).cast("long").alias("user_id"), F.lit("https://a.example/x").alias("url"),
        F.lit("t").alias("title"), F.lit(30_000).cast("long").alias("duration"), (F.hash("id") % 1000).cast("long").alias("timestamp"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = st.history_view(rows, sort_field="duration", order="desc").collect()
        parts = rows.repartitionByRange(F.asc_nulls_first("user_id"), F.col("duration").desc(), "timestamp", "id").groupBy(F.spark_partition_id()).count()
        assert parts.count() == 8 and parts.agg(F.max("count")).first()[0] < 4000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for user in (1, None):
        own = sorted((r for r in got if r.user_id == user), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1)) and len(own) in (18_000, 2000)
        assert [(r.timestamp, r.id) for r in own] == sorted((r.timestamp, r.id) for r in own)
    none = with_rank(rows.limit(0), ["user_id"], [F.col("id").asc()])
    assert none.count() == 0 and none.columns == [*rows.columns, "position"]
