"""Scalar functions: time formats, rounding, URL normalisation, time helpers."""

from pyspark.sql import functions as F

from tabtrail.functions import formats as fm
from tabtrail.functions.time import iso_ts, local_hour, ntz_to_ms, utc_day
from tabtrail.functions.urls import domain, normalize_url, with_url_parts


def one(spark, col, value, typ="long"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


def test_formats(spark):
    assert one(spark, fm.format_hm, 3725000) == "1h 2m"
    assert one(spark, fm.format_hms, 3725000) == "1h 2m"
    assert one(spark, fm.format_clock, 3725000) == "1:02:05"
    assert one(spark, fm.format_hms, 125000) == "2m 5s"
    assert one(spark, fm.format_hms, 5000) == "5s"
    assert one(spark, fm.format_clock, 65000) == "1:05"
    assert one(spark, fm.format_hm, 59999) == "0m"


def test_js_round_and_fixed(spark):
    assert one(spark, fm.js_round, -0.5, "double") == 0
    assert one(spark, fm.js_round, 2.5, "double") == 3
    df = spark.createDataFrame([(1, 8), (145, 10000), (3, 2), (1, 3)], "a long, b long")
    got = [r[0] for r in df.select(fm.percent_1("a", "b")).collect()]
    assert got == ["12.5", "1.5", "150.0", "33.3"]
    got = [r[0] for r in df.select(fm.fixed_ratio("a", "b", 2)).collect()]
    assert got == ["0.13", "0.01", "1.50", "0.33"]


def test_time_helpers(spark):
    df = spark.createDataFrame([(1704067207179,)], "ms long")
    r = df.select(utc_day("ms").alias("d"), iso_ts("ms").alias("i"), local_hour("ms").alias("h"),
                  local_hour("ms", "Asia/Tokyo").alias("ht")).first()
    assert (r.d, r.i, r.h, r.ht) == ("2024-01-01", "2024-01-01T00:00:07.179Z", 0, 9)
    ntz = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:07.179575' AS t")
    assert ntz.select(ntz_to_ms("t")).first()[0] == 1704067207179


URLS = {
    "https://Example.COM:443/a/b?x=1#f": ("https://example.com/a/b", "example.com"),
    "http://user:pw@host.org:80": ("http://host.org/", "host.org"),
    "http://host.org:8080/p": ("http://host.org:8080/p", "host.org"),
    "chrome://settings": ("chrome://settings/", "settings"),
    "not a url": ("not a url", "not a url"),
    "https://a.b/c#s1": ("https://a.b/c", "a.b"),
}


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: (r.n, r.d) for r in df.select("url", normalize_url("url").alias("n"),
                                                   domain("url").alias("d")).collect()}
    assert got == URLS
    staged = with_url_parts(df, "url", "n", "d").collect()
    assert {r.url: (r.n, r.d) for r in staged} == URLS
