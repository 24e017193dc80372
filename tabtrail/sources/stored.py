"""Stored session tables, partitioned by UTC day (P1 on what S4 appends).

Sessions carry epoch milliseconds; the table's folders carry days. A range in milliseconds is turned into a range of
days, which Spark applies to the list of folders, and stays as a filter on the rows. Ranges of their
own per user are joined on the day as well, so that Spark prunes the folders by the ranges' days when it runs
(dynamic partition pruning).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtrail.functions.time import day_string, utc_date
from tabtrail.sources import sinks

DAY = "date"


def append_by_day(s: DataFrame, path: str, time_col: str = "timestamp", fmt: str = "parquet") -> None:
    """Append sessions below their UTC day."""
    sinks.append(s.withColumn(DAY, day_string(F.col(time_col))), path, fmt, [DAY])


def _day(ms: int) -> Column:
    return F.lit(dt.date(1970, 1, 1) + dt.timedelta(days=ms // 86_400_000))


def read_range(spark: SparkSession, path: str, start: int | None = None, end: int | None = None,
               time_col: str = "timestamp", fmt: str = "parquet") -> DataFrame:
    """Rows with ``start <= time <= end``; only the folders of these days are listed for the scan."""
    x = spark.read.format(fmt).load(path)
    day, time = F.col(DAY).cast("date"), F.col(time_col)
    if start is not None:
        x = x.filter((day >= _day(start)) & (time >= start))
    if end is not None:
        x = x.filter((day <= _day(end)) & (time <= end))
    return x


def in_ranges(stored: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("user_id",), time_col: str = "timestamp") -> DataFrame:
    """Rows of ``stored`` in the ranges (keys, start, end) of their key, with ``start`` and ``end``; a row in two
    ranges of its key comes twice."""
    days = F.sequence(utc_date(F.col("start")), utc_date(F.col("end")))
    r = ranges.filter(F.col("start") <= F.col("end")).select(*keys, "start", "end", F.explode(days).alias("_range_day"))
    x = stored.withColumn("_range_day", F.col(DAY).cast("date")).join(r, [*keys, "_range_day"])
    return x.filter(F.col(time_col).between(F.col("start"), F.col("end"))).select(*stored.columns, "start", "end")
