"""Windowed streaming statistics and triggers (ST4, ST5, ST6) and stream sinks.

* ``live_day_categories`` (ST5): per user, local day and category name -- time and rows --
  as a watermarked tumbling-window aggregation (update or append mode).
* ``late_night_stream`` (ST6): first session start per user and night with local hour in
  [1, 7) -- a watermarked aggregation, emitted once when the night's window closes.
  ``late_night_prompt`` alerts in the batch of the first late session instead.
* ``categorize_batches`` (ST4): a ``foreachBatch`` function that categorises each
  micro-batch (rules + fallback) and appends it; run it with
  ``trigger(processingTime="15 minutes")`` or ``trigger(availableNow=True)``.
  ``backlog_batches`` (ST4, C3) keeps a table instead: rows come in by key, the backlog is
  categorised in place, and a ledger makes each epoch count once.
* ``cleanup_stream`` (M2): merged sessions by ``session_window`` with a gap per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtrail.constants import CLEANUP_MAX_GAP_MS, LATE_NIGHT_FROM_HOUR, LATE_NIGHT_UNTIL_HOUR
from tabtrail.functions.time import day_string, local_hour, local_wall, ntz_to_ms, utc_day
from tabtrail.operators.categorize import categorize, categorize_backfill, categorize_summary
from tabtrail.operators.stats import with_category
from tabtrail.sources.sinks import _exists, write_upsert

#: A night may last 7 hours (01:00 to 07:00 with an hour that comes twice), and a key's first alert
#: is remembered for the watermark's delay.
NIGHT_WATERMARK = "8 hours"


def _timed(s: DataFrame, watermark: str, tz: str) -> DataFrame:
    """``event_time``: local wall time of the row, so that one-day windows are local days. When
    clocks go back rows look up to an hour older, which the watermark has to allow."""
    wall = F.col("timestamp") if tz == "UTC" else ntz_to_ms(local_wall(F.col("timestamp"), tz))
    return s.withColumn("event_time", F.timestamp_millis(wall)).withWatermark("event_time", watermark)


def _day(window: str):
    return utc_day(F.unix_millis(F.col(window + ".start")))


def live_day_categories(s: DataFrame, c: DataFrame, tz: str = "UTC",
                        watermark: str = "2 hours") -> DataFrame:
    """ST5 over a categorised session stream joined to the (static) categories, by local day."""
    x = with_category(_timed(s, watermark, tz), c, ("name",))
    g = x.groupBy("user_id", F.window("event_time", "1 day").alias("day"),
                  F.col("category_name").alias("name")).agg(
        F.sum("duration").alias("time"), F.count(F.lit(1)).alias("count"))
    return g.select("user_id", _day("day").alias("date"), "name", "time", "count")


def late_night_stream(s: DataFrame, tz: str = "UTC", watermark: str = "2 hours") -> DataFrame:
    """ST6: one reminder per user and local night, at the first late-night session.

    The hour is taken from the event-time column on purpose: a filter that does not
    reference it is pushed below the watermark, and then only late-night rows would
    move the watermark (the nights would close only at the next late-night session)."""
    h = local_hour(F.unix_millis(F.col("event_time")))
    x = _timed(s, watermark, tz).filter((h >= LATE_NIGHT_FROM_HOUR) & (h < LATE_NIGHT_UNTIL_HOUR))
    g = x.groupBy("user_id", F.window("event_time", "1 day").alias("w")).agg(
        F.min("timestamp").alias("alert_ts"), F.count(F.lit(1)).alias("late_sessions"))
    return g.select("user_id", _day("w").alias("night"), "alert_ts", "late_sessions")


def categorize_batches(c: DataFrame, sink: Callable[[DataFrame, int], None],
                       classifier=None) -> Callable[[DataFrame, int], None]:
    """ST4: ``foreachBatch`` body -- categorise the rows of a micro-batch, then ``sink``."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        sink(categorize(batch, c, classifier), epoch_id)
    return run


def late_night_prompt(s: DataFrame, tz: str = "UTC", watermark: str = NIGHT_WATERMARK) -> DataFrame:
    """ST6 at once: the first late-night session of a user and local night that arrives is the alert, in its own
    batch; later ones of the night are dropped. ``watermark`` must not be shorter than a night, for a key is
    forgotten that long after its first row. Time is epoch time here, so a change of clocks moves nothing."""
    x = s.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", watermark)
    ms = F.unix_millis(F.col("event_time"))      # as above: a filter on another column would go below the watermark
    h = local_hour(ms, tz)
    x = x.filter((h >= LATE_NIGHT_FROM_HOUR) & (h < LATE_NIGHT_UNTIL_HOUR)).withColumn("night", day_string(ms, tz))
    return x.dropDuplicatesWithinWatermark(["user_id", "night"]).select("user_id", "night", F.col("timestamp").alias("alert_ts"))


def cleanup_stream(s: DataFrame, gap_ms: int = CLEANUP_MAX_GAP_MS, watermark: str = "2 hours") -> DataFrame:
    """M2 on a session stream: rows of a user and URL merge while each starts at most ``gap_ms`` after the latest end
    so far; a merged row comes out when the watermark passes its end and gap (append mode).

    The batch rule compares with the end of the previous row, this one with the latest end, so they
    agree wherever no row ends before an earlier one of its user and URL does. Otherwise this one may merge more: of (0, 300000),
    (10000, 1000), (140000, 1000) as (start, duration) the batch makes two rows, the stream one."""
    x = s.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", watermark)
    gap = F.concat((F.col("duration") + F.lit(gap_ms + 1)).cast("string"), F.lit(" milliseconds"))
    first = F.min_by(F.struct("id", "title", "timestamp"), F.struct("timestamp", "id"))
    g = x.groupBy("user_id", "url", F.session_window("event_time", gap).alias("w")).agg(
        first.alias("f"), F.sum("duration").alias("duration"), F.count(F.lit(1)).alias("merged_rows"))
    return g.select("f.id", "user_id", "url", "f.title", "f.timestamp", "duration", "merged_rows")


def backlog_batches(c: DataFrame, path: str, ledger: str, classifier=None,
                    limit: int | None = None) -> Callable[[DataFrame, int], None]:
    """ST4 and C3: ``foreachBatch`` body that upserts the batch's sessions into the table at ``path`` (by id; partitioned by
    UTC day) and then categorises the table's backlog in place.

    ``ledger`` has a folder an epoch: ``begun`` holds the run's counters per user (A13: categorized, total) and is
    written before the table changes, ``done`` after. An epoch with ``done`` is skipped; one that stopped in between
    runs again and keeps its first counters. Rows are written by key, so a repeated run changes nothing."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark, at = batch.sparkSession, f"{ledger.rstrip('/')}/epoch={epoch_id}"
        if _exists(spark, f"{at}/done/_SUCCESS"):
            return
        keys = ["id", "date"]
        arrived = batch.withColumn("date", day_string(F.col("timestamp")))
        if _exists(spark, path):      # a session that has a category keeps it when its row comes again
            known = spark.read.schema(arrived.schema).parquet(path).select(*keys, F.col("category_id").alias("_known"))
            arrived = arrived.join(known, keys, "left").select(
                *[F.coalesce("category_id", "_known").alias(x) if x == "category_id" else F.col(x) for x in arrived.columns])
        table = write_upsert(arrived, path, keys, partition_by=["date"])
        filled = categorize_backfill(table, c, classifier, limit).checkpoint()
        if not _exists(spark, f"{at}/begun/_SUCCESS"):
            categorize_summary(filled).write.mode("overwrite").parquet(f"{at}/begun")
        now = filled.filter("updated").withColumnRenamed("new_category_id", "category_id").select(*table.columns)
        write_upsert(now, path, keys, partition_by=["date"])
        categorize_summary(filled).limit(0).write.mode("overwrite").parquet(f"{at}/done")
    return run
