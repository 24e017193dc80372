"""Stream = batch: file source + availableNow trigger, several micro-batches."""

import tempfile

from tabtrail.operators import capture as cp
from tabtrail.operators import merge as mg
from tabtrail.sources import fixtures as fx
from tabtrail.streaming.capture import capture_stream
from tabtrail.streaming.ingest import ingest_stream
from tabtrail.streaming.live import late_night_stream, live_day_categories

SF = "/root/testdata/sf0.001"


def run_stream(spark, df, build, mode="append", files=3, order="timestamp", sentinel=None):
    src = tempfile.mkdtemp(prefix="tt-stream-src-")
    # write in time order as separate files -> separate micro-batches
    df = df.orderBy(order)
    n = df.count()
    parts = df.randomSplit([1.0] * files, seed=1) if False else None
    from pyspark.sql import functions as F
    from pyspark.sql import Window
    x = df.withColumn("_slice", F.ntile(files).over(Window.orderBy(order)))
    for i in range(1, files + 1):
        x.filter(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(
            f"{src}/p{i}")
    if sentinel is not None:
        # far-future rows in two more micro-batches: the first moves the watermark, the
        # second runs with it and closes every open window / timed-out state
        spark.createDataFrame([sentinel], df.schema).write.parquet(f"{src}/p{files + 1}")
        spark.createDataFrame([sentinel], df.schema).write.parquet(f"{src}/p{files + 2}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    name = "q" + tempfile.mktemp(dir="").replace("-", "_").replace("/", "")[-8:]
    q = (build(stream).writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tt-ckpt-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert n > 0
    return spark.table(name)


def key(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ingest_stream_equals_batch(spark):
    chunks = fx.chunks(spark, SF)
    sentinel = (-1, -1, "sentinel", None, 1800000000000, 30000)
    got = run_stream(spark, chunks, ingest_stream, sentinel=sentinel).filter("user_id >= 0")
    assert got.filter("status <> 'final'").count() == 0
    cols = ("id", "user_id", "url", "timestamp", "duration", "merged_chunks")
    assert key(got, cols) == key(mg.ingest_merge(chunks), cols)


def test_ingest_stream_routes_out_of_order_chunks(spark):
    t0 = 1704067200000
    rows = [(1, 1, "u", "t", t0, 10000), (2, 1, "u", "t", t0 + 30000, 10000),
            (3, 1, "u", "t", t0 + 10000, 5000),         # arrives after t0 + 30 s: late
            (-1, -1, "s", None, 1800000000000, 1000)]
    df = spark.createDataFrame(rows, "id long, user_id long, url string, title string, "
                                     "timestamp long, duration long")
    src = tempfile.mkdtemp(prefix="tt-late-")
    import time
    for i, r in enumerate(rows + [rows[-1]]):
        spark.createDataFrame([r], df.schema).coalesce(1).write.parquet(f"{src}/p{i}")
        time.sleep(1.1)      # distinct modification times keep the file order
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    q = (ingest_stream(stream).writeStream.format("memory").queryName("late_route")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tt-ckpt-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r.id, r.status, r.duration) for r in spark.table("late_route").filter("user_id = 1").collect()}
    assert got == {(1, "final", 20000), (3, "late", 5000)}


def test_capture_stream_equals_batch(spark):
    ev = fx.tab_events(spark, SF)
    got = run_stream(spark, ev, capture_stream, order="ts_ms")
    assert got.filter("status <> 'closed'").count() == 0
    cols = ("user_id", "event_id", "start_ts", "end_ts", "duration", "end_kind")
    assert key(got, cols) == key(cp.tab_sessions(ev), cols)


def test_live_windows_equal_batch(spark):
    s = fx.categorized_sessions(spark, SF)
    c = fx.categories(spark)
    sentinel = (-1, -1, "sentinel", None, 1000, 1800000000000, None)
    got = run_stream(spark, s, lambda st: live_day_categories(st, c),
                     sentinel=sentinel).filter("user_id >= 0")
    from pyspark.sql import functions as F
    from tabtrail.functions.time import utc_day
    from tabtrail.operators import stats as stt
    want = stt.with_category(s, c, ("name",)).groupBy(
        "user_id", utc_day("timestamp").alias("date"), F.col("category_name").alias("name")).agg(
        F.sum("duration").alias("time"), F.count(F.lit(1)).alias("count"))
    cols = ("user_id", "date", "name", "time", "count")
    assert key(got, cols) == key(want, cols)
    late = run_stream(spark, s, late_night_stream, sentinel=sentinel).filter("user_id >= 0")
    cols = ("user_id", "night", "alert_ts", "late_sessions")
    assert key(late, cols) == key(cp.late_night_alerts(s), cols)


def test_scheduled_categorization_foreach_batch(spark):
    from tabtrail.streaming.live import categorize_batches
    s = fx.sessions(spark, SF)
    c = fx.categories(spark)
    seen = []

    def sink(df, epoch):
        seen.extend(r.asDict() for r in df.select("id", "category_id").collect())

    src = tempfile.mkdtemp(prefix="tt-st4-")
    s.coalesce(1).write.parquet(src + "/a")
    q = (spark.readStream.schema(s.schema).option("recursiveFileLookup", "true").parquet(src)
         .writeStream.foreachBatch(categorize_batches(c, sink))
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tt-ckpt-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    from tabtrail.operators.categorize import categorize
    want = {r.id: r.category_id for r in categorize(s, c).collect()}
    assert {r["id"]: r["category_id"] for r in seen} == want


def feed(spark, rows, schema, build):
    """Rows one by one, each in a micro-batch of its own, in the given order."""
    import time
    src = tempfile.mkdtemp(prefix="tt-feed-")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(f"{src}/p{i}")
        time.sleep(1.1)      # distinct modification times keep the file order
    name = "f" + tempfile.mktemp(dir="").replace("-", "_").replace("/", "")[-8:]
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema) \
        .option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = (build(stream).writeStream.format("memory").queryName(name)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tt-ckpt-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.table(name).collect()


TAB = "event_id long, user_id long, ts_ms long, kind string, tab_id long, url string, title string"
T0 = 1704067200000
HOUR = 3_600_000


def test_capture_keeps_long_sessions_late_events_and_tab_ids(spark):
    rows = [(1, 1, T0, "activated", 7, "https://a.example/", "a"),
            (2, 2, T0 + 30 * HOUR, "activated", 1, "https://b.example/", "b"),       # another user moves time on
            (9, 1, T0 - 100_000, "activated", 3, "https://old.example/", "old"),      # older than the open session
            (3, 1, T0 + 31 * HOUR, "focus_lost", None, None, None)]
    got = {(r.event_id, r.status, r.tab_id, r.elapsed_ms) for r in feed(spark, rows, TAB, capture_stream) if r.user_id == 1}
    assert got == {(1, "closed", 7, 31 * HOUR), (9, "late", 3, 0)}


def test_null_tab_in_the_batch_that_opens_a_session(spark):
    src = tempfile.mkdtemp(prefix="tt-tab-")
    rows = [(1, 1, T0, "focus_lost", None, None, None), (2, 1, T0 + 1000, "activated", 7, "https://a.example/", "a")]
    spark.createDataFrame(rows, TAB).coalesce(1).write.parquet(src + "/p0")
    import time
    time.sleep(1.1)
    spark.createDataFrame([(3, 1, T0 + 9000, "focus_lost", None, None, None)], TAB).coalesce(1).write.parquet(src + "/p1")
    stream = spark.readStream.schema(spark.createDataFrame([], TAB).schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    q = (capture_stream(stream).writeStream.format("memory").queryName("null_tab")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tt-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert [(r.event_id, r.tab_id, r.duration) for r in spark.table("null_tab").collect()] == [(2, 7, 8000)]


def test_chunks_behind_the_watermark_come_out_as_late(spark):
    schema = "id long, user_id long, url string, title string, timestamp long, duration long, arrived long"
    rows = [(1, 1, "u", "t", T0, 10_000, T0), (2, 2, "v", "t", T0 + 5 * HOUR, 10_000, T0 + 5 * HOUR),
            (3, 3, "w", "t", T0 + HOUR, 10_000, T0 + 5 * HOUR),                  # four hours behind
            (-1, -1, "s", None, T0 + 90 * HOUR, 1000, T0 + 90 * HOUR), (-2, -1, "s", None, T0 + 91 * HOUR, 1000, T0 + 91 * HOUR)]
    got = feed(spark, rows, schema, lambda c: ingest_stream(c, arrival_col="arrived"))
    assert {(r.id, r.status) for r in got if r.user_id > 0} == {(1, "final"), (2, "final"), (3, "late")}


def test_local_nights_equal_batch(spark):
    s = fx.categorized_sessions(spark, SF)
    sentinel = (-1, -1, "sentinel", None, 1000, 1800000000000, None)
    got = run_stream(spark, s, lambda x: late_night_stream(x, "Europe/Moscow"), sentinel=sentinel).filter("user_id >= 0")
    cols = ("user_id", "night", "alert_ts", "late_sessions")
    assert key(got, cols) == key(cp.late_night_alerts(s, "Europe/Moscow"), cols)
