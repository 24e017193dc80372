"""Sinks (upsert with checkpointed lineage, appends, rebuild) and the driver entry."""

import json
import os
import tempfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabtrail.sources import fixtures as fx
from tabtrail.sources import sinks

SF = "/root/testdata/sf0.001"


def test_upsert_and_rebuild(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tt-sink-"), "scores")
    a = spark.createDataFrame([(1, "2024-01-01", 10), (1, "2024-01-02", 20)],
                              "user_id long, date string, score long")
    b = spark.createDataFrame([(1, "2024-01-02", 25), (2, "2024-01-02", 5)],
                              "user_id long, date string, score long")
    sinks.write_upsert(a, path, ["user_id", "date"])
    out = sinks.write_upsert(b, path, ["user_id", "date"])
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, "2024-01-01", 10), (1, "2024-01-02", 25), (2, "2024-01-02", 5)]
    vpath = os.path.join(tempfile.mkdtemp(prefix="tt-vec-"), "vectors")
    s = fx.categorized_sessions(spark, SF)
    sinks.rebuild_vectors(s, fx.categories(spark), vpath)
    v = spark.read.parquet(vpath)
    assert v.count() == s.count()
    assert v.first()["metadata"]["source"] == "browser_session"


def files(path):
    """Data files below a table with their inode numbers: a file that is kept keeps its number."""
    return {os.path.relpath(os.path.join(f, n), path): os.stat(os.path.join(f, n)).st_ino
            for f, _, names in os.walk(path) for n in names if n.startswith("part-")}


SCORES = "user_id long, date string, score long, seq long"


def test_upsert_rewrites_touched_partitions_only(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tt-sink-"), "scores")
    days = [f"2024-01-{i:02d}" for i in range(1, 9)] + [None]
    a = spark.createDataFrame([(u, d, 10, 0) for u in (1, 2, None) for d in days], SCORES)
    b = spark.createDataFrame([(1, "2024-01-02", 5, 1), (1, "2024-01-02", 9, 3), (1, "2024-01-02", 7, 2), (None, "2024-01-02", 8, 1),
                               (2, None, 4, 1), (3, "2024-02-01", 6, 1)], SCORES)
    keys = ["user_id", "date"]
    write = lambda x: sinks.write_upsert(x, path, keys, partition_by=["date"], order_by=["seq"], columns=["user_id", "date", "score"])
    assert write(a).count() == 27
    before = files(path)
    out = write(b)
    assert out.dtypes == [("user_id", "bigint"), ("date", "string"), ("score", "bigint")]
    got = {(r.user_id, r.date): r.score for r in out.collect()}
    want = {(u, d): 10 for u in (1, 2, None) for d in days} | {
        (1, "2024-01-02"): 9, (None, "2024-01-02"): 8, (2, None): 4, (3, "2024-02-01"): 6}
    assert got == want and out.count() == len(want)
    after = files(path)
    touched = ("date=2024-01-02/", "date=__HIVE_DEFAULT_PARTITION__/", "date=2024-02-01/")
    assert {f: i for f, i in after.items() if not f.startswith(touched)} == {
        f: i for f, i in before.items() if not f.startswith(touched)}
    assert not {f for f in after if f.startswith(touched)} & set(before)
    with pytest.raises(ValueError):
        sinks.write_upsert(b, path, ["user_id"], partition_by=["date"])


def test_failed_upsert_leaves_the_table(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tt-sink-"), "scores")
    a = spark.createDataFrame([(u, f"2024-01-0{d}", 10, 0) for u in range(50) for d in range(1, 6)], SCORES)
    keys = ["user_id", "date"]
    sinks.write_upsert(a, path, keys, partition_by=["date"])
    victim = next(os.path.join(path, f) for f in files(path) if f.startswith("date=2024-01-03"))
    os.rename(victim, victim + ".whole")          # its place is taken by a file that cannot be read
    with open(victim, "wb") as f:
        f.write(b"PAR1 not a table PAR1")
    before = files(path)
    with pytest.raises(Exception):
        sinks.write_upsert(a.withColumn("score", F.lit(1).cast("long")), path, keys, partition_by=["date"])
    assert files(path) == before
    os.rename(victim + ".whole", victim)
    assert {r.score for r in spark.read.parquet(path).select("score").collect()} == {10}


def test_bucketed_upsert_and_many_partitions(spark, monkeypatch):
    path = os.path.join(tempfile.mkdtemp(prefix="tt-sink-"), "vectors")
    v = spark.createDataFrame([(str(i), [float(i)]) for i in range(300)] + [(None, [0.0])], "id string, values array<float>")
    sinks.write_upsert(v, path, ["id"])
    before = files(path)
    now = sinks.write_upsert(spark.createDataFrame([("7", [1.5]), ("new", [2.5]), (None, [3.5])], v.schema), path, ["id"])
    got = {r.id: r["values"] for r in now.collect()}
    assert len(got) == now.count() == 302 and (got["7"], got["new"], got[None], got["8"]) == ([1.5], [2.5], [3.5], [8.0])
    assert len(set(files(path).items()) & set(before.items())) >= len(before) - 3
    monkeypatch.setattr(sinks, "LISTED_PARTITIONS", 0)
    assert sinks.write_upsert(v, path, ["id"]).count() == 302


def test_rebuild_keeps_the_old_table_until_the_new_one_is_whole(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tt-sink-"), "t")
    sinks.replace_table(spark.range(5), path)
    bad = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        sinks.replace_table(bad, path)
    assert spark.read.parquet(path).count() == 5
    sinks.replace_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and not [n for n in os.listdir(os.path.dirname(path)) if ".old-" in n]


def test_reflection_and_insight_records(spark):
    q = spark.createDataFrame([(1, 3, "how?", 1000)], "id long, user_id long, query string, timestamp long")
    ctx = spark.createDataFrame([(3, 2, "text")], "user_id long, total_sessions long, context string")
    r = sinks.reflection_records(q, ctx).first()
    assert json.loads(r.context) == {"total_sessions": 2, "context": "text"} and r.response == "text"
    plan = spark.createDataFrame([(3, "2024-01-02", "no_activity", None, None, None),
                                  (3, "2024-01-03", "generate", "1h 2m", 4, "Learning"),
                                  (3, "2024-01-04", "cached", "1m", 1, "Learning")],
                                 "user_id long, date string, action string, total_text string, "
                                 "session_count long, top_category string")
    ins = sinks.insight_records(plan, 0).orderBy("date").collect()
    assert len(ins) == 2 and ins[1].metadata.topCategory == "Learning"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


ORACLE_SAMPLE = ["wellness_daily", "display_merge", "cleanup_duplicates", "tab_sessions",
                 "reflection_context", "category_changes", "categorize_sessions", "history_search"]


def test_oracles_sample_sf0001(spark):
    con = duckdb.connect()
    for t in ["events", "embeddings", "pages", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    for name in ORACLE_SAMPLE:
        s = qs[name](spark, SF).toPandas()
        o = con.execute(sqls[name]).df()
        cols = sorted(s.columns)
        assert cols == sorted(o.columns), name

        def cell(x):
            if x is None or x is pd.NA or (isinstance(x, float) and x != x):
                return None
            if hasattr(x, "item"):
                x = x.item()
            return round(x, 6) if isinstance(x, float) else x

        def norm(df):
            return sorted((tuple(cell(x) for x in r) for r in df[cols].itertuples(index=False)),
                          key=lambda t: tuple((v is None, str(v)) for v in t))
        assert norm(s) == norm(o), name


def test_declared_schemas_roundtrip(spark):
    from tabtrail.sources.schemas import SCHEMAS, conform, read_input
    s = conform(fx.sessions(spark, SF), "sessions")
    path = os.path.join(tempfile.mkdtemp(prefix="tt-schema-"), "sessions")
    s.write.parquet(path)
    back = read_input(spark, "sessions", path)
    assert [f.name for f in back.schema.fields] == [f.name for f in SCHEMAS["sessions"].fields]
    assert back.count() == s.count()
    stream = read_input(spark, "sessions", path, stream=True)
    assert stream.isStreaming
