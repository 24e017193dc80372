"""Physical plan properties: broadcast dimension joins, pushed scan filters and
pruned columns, no single-partition exchange before windows."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dimension_join_is_broadcast(spark):
    p = plan(entry.queries()["wellness_daily"](spark, SF))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def scans(df):
    return [line for line in plan(df).split("\n") if "FileScan parquet" in line]


def test_scan_prunes_columns(spark):
    found = scans(entry.queries()["daily_stats"](spark, SF))
    assert found and all("event_type" not in s and "event_id" not in s for s in found)


def test_time_bounds_reach_the_scan(spark):
    """Of the registered queries' own plans."""
    for name in ["today_categories", "activity_summary", "learning_sessions", "sessions_by_category",
                 "reflection_context_stats", "daily_stats", "category_stats"]:
        found = scans(entry.queries()[name](spark, SF))
        assert found and all("GreaterThanOrEqual(ts," in s for s in found), name
    found = scans(entry.queries()["today_stats"](spark, SF))
    bounded = [s for s in found if "GreaterThanOrEqual(ts,2024-01-15" in s and "LessThan(ts,2024-01-16" in s]
    users = [s for s in found if "ReadSchema: struct<user_id:bigint>" in s]
    assert bounded and len(bounded) + len(users) == len(found)


def test_default_fallback_moves_no_session(spark):
    p = plan(entry.queries()["categorize_sessions"](spark, SF))
    assert "Exchange hashpartitioning" not in p and p.count("FileScan parquet") == 1


def test_one_plan_whatever_the_size(spark):
    from tabtrail.operators import merge as mg
    from tabtrail.sources import fixtures as fx
    p = plan(mg.display_merge(fx.chunks(spark, SF, True)))
    assert "hashpartitioning(_pk" in p and "SinglePartition" not in p


def test_no_single_partition_windows(spark):
    for name in ["display_merge", "cleanup_duplicates", "tab_sessions", "category_runs",
                 "sessions_listing", "reflection_context_stats"]:
        p = plan(entry.queries()[name](spark, SF))
        assert "SinglePartition" not in p, name


def test_topk_limits_before_shuffle(spark):
    for name in ["sessions_listing", "similar_sessions", "last_n_per_user"]:
        p = plan(entry.queries()[name](spark, SF))
        lines = p.split("\n")
        ex = [i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l]
        assert ex and any("WindowGroupLimit" in l for l in lines[ex[0] + 1:]), name


def test_fact_aggregation_is_hash_based(spark):
    p = plan(entry.queries()["category_stats"](spark, SF))
    assert "HashAggregate(keys=[user_id" in p


def test_generated_code_compiles(spark):
    """With codegen fallback off, a method over the 64 KB JVM limit raises instead of
    silently running interpreted (slowly)."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ["sessions_by_category", "categorize_by_url", "display_merge",
                     "uncategorized_backlog", "category_delete_cascade"]:
            entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", "true")


def test_merges_scan_once_and_join_nothing(spark):
    spark.catalog.clearCache()      # another test's cached frame would take the scan's place
    for name in ["cleanup_duplicates", "cleanup_summary", "display_merge"]:
        p = plan(entry.queries()[name](spark, SF))
        assert p.count("FileScan parquet") == 1 and "Join" not in p, name
        assert p.count("Exchange hashpartitioning") <= 3, name


def test_stored_ranges_read_their_days_only(spark, tmp_path):
    from pyspark.sql import functions as F
    from tabtrail.sources import fixtures as fx
    from tabtrail.sources import stored
    path, day = str(tmp_path / "t"), 86_400_000
    s = fx.sessions(spark, SF)
    stored.append_by_day(s, path)
    stored.append_by_day(s.limit(0), path)
    t0 = 1704067200000 + 5 * day
    x = stored.read_range(spark, path, t0 + 1000, t0 + 2 * day)
    line = next(x for x in plan(x).split("\n") if "FileScan" in x)
    assert "PartitionFilters" in line and "date" in line.split("PartitionFilters")[1].split("PushedFilters")[0]
    files = {f.split("date=")[1][:10] for f in x.inputFiles()}
    assert x.count() == s.filter(F.col("timestamp").between(t0 + 1000, t0 + 2 * day)).count() > 0
    read = {r.f.split("date=")[1][:10] for r in x.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read <= {"2024-01-06", "2024-01-07", "2024-01-08"} and len(files) >= len(read)
    ranges = spark.createDataFrame([(1, t0, t0 + day), (2, t0 + day, t0 + day + 5), (2, t0, t0 + 3 * day), (3, t0 + 1, t0), (None, t0, t0 + day)],
                                   "user_id long, start long, end long")
    got = stored.in_ranges(stored.read_range(spark, path), ranges)
    assert "dynamicpruning" in plan(got)
    want = s.join(ranges, "user_id").filter(F.col("timestamp").between(F.col("start"), F.col("end")))
    key = lambda df: sorted(map(tuple, df.select("id", "start", "end").collect()))
    assert key(got) == key(want) != []
