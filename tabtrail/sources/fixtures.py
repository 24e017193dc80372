"""Derive the session-analytics input tables from the driver's generic tables.

Mapping (FIXTURES.md section 3): one session per ``events`` row, chunked into 30 s
autosave pieces with planned gaps; tab events from the same rows; session vectors from
``embeddings``; reflections from ``conversations``. Everything is a narrow projection
(no shuffle) except ``reflections`` (one window per conversation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabtrail.constants import AUTOSAVE_MS, CHUNK_ID_FACTOR, DAY_MS, MIN_CHUNK_MS
from tabtrail.functions.formats import idiv
from tabtrail.functions.time import ntz_literal, ntz_to_ms
from tabtrail.sources.catalog import N_SITES, SITES
from tabtrail.sources.tables import read_table, seed_categories

EPOCH_2024_MS = 1704067200000      # 2024-01-01T00:00:00Z
FIXED_NOW_MS = 1706659200000       # 2024-01-31T00:00:00Z
TODAY_START_MS = 1705276800000     # 2024-01-15T00:00:00Z
TODAY_END_MS = 1705363199999       # 2024-01-15T23:59:59.999Z
SESSIONS_A_PART = 50_000
TAB_TIME_COMPRESSION = 200         # tab events: gaps of minutes, not hours

EVENT_KIND = {"click": "activated", "purchase": "activated", "view": "url_updated",
              "signup": "focus_gained", "error": "focus_lost"}


def site_id(props: Column) -> Column:
    return F.regexp_extract(props, r"([0-9]+)", 1).try_cast("long") % N_SITES


def _site_lookup(pos: int, sid: str) -> Column:
    from tabtrail.functions.sqlexpr import cached_expr, sql_str
    arr = ", ".join(sql_str(row[pos]) for row in SITES)
    return cached_expr(f"try_element_at(array({arr}), CAST({sid} + 1 AS INT))")


def site_url(sid: str = "_site") -> Column:
    """URL of the site id in column ``sid`` (one parsed lookup expression)."""
    return _site_lookup(0, sid)


def site_title(sid: str = "_site") -> Column:
    return _site_lookup(1, sid)


def _events(spark: SparkSession, base: str, start: int | None = None,
            end: int | None = None) -> DataFrame:
    """Event rows; bounds in epoch ms (inclusive) become bounds of the stored ``ts``, which
    the scan can use to skip row groups."""
    ev = read_table(spark, base, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props")
    if start is not None:
        ev = ev.filter(F.col("ts") >= ntz_literal(start))
    if end is not None:
        ev = ev.filter(F.col("ts") < ntz_literal(end + 1))
    return ev


def sessions(spark: SparkSession, base: str, start: int | None = None,
             end: int | None = None) -> DataFrame:
    """Raw sessions: id, user_id, url, title, duration (ms), timestamp (ms), category_id (null).
    ``start``/``end``: only sessions with a timestamp inside these bounds."""
    ev = _events(spark, base, start, end).withColumn("_site", site_id(F.col("props")))
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        site_url().alias("url"),
        site_title().alias("title"),
        (F.round(F.col("value") * 100).cast("long") * 100).alias("duration"),
        ntz_to_ms(F.col("ts")).alias("timestamp"),
        F.lit(None).cast("long").alias("category_id"),
    )


def uploaded_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Sessions as a client uploads them, some with a field missing (by event id)."""
    gone = lambda c, n, v: F.when(F.col("id") % n == 0, v).otherwise(F.col(c)).alias(c)
    none = F.lit(None)
    return sessions(spark, base).select(
        "id", "user_id", gone("url", 17, none), "title", gone("duration", 23, F.lit(0)),
        gone("timestamp", 29, none), "category_id")


def categories(spark: SparkSession, base: str | None = None) -> DataFrame:
    return seed_categories(spark)


def categorized_sessions(spark: SparkSession, base: str, start: int | None = None,
                         end: int | None = None) -> DataFrame:
    """Sessions with ``category_id`` set by the URL rules (null where no rule matches)."""
    from tabtrail.operators.categorize import categorize_by_rules
    return categorize_by_rules(sessions(spark, base, start, end), categories(spark))


def expand_chunks(s: DataFrame, url_variant: bool = False) -> DataFrame:
    """Split each session into 30 s autosave chunks with planned gaps.

    Chunk i starts at ``ts + 30000*i + 36000*(i div 7) + 130000*(i div 20)`` and lasts
    ``min(30000, duration - 30000*i)``; chunks under 3 s are dropped. The extra terms
    place 36 s gaps (break the ingest merge only) and > 120 s gaps (break both).
    """
    n_last = F.greatest(idiv(F.col("duration") + (AUTOSAVE_MS - 1), AUTOSAVE_MS) - 1, F.lit(0))
    x = s.select("id", "user_id", "url", "title", "duration", "timestamp",
                 F.explode(F.sequence(F.lit(0).cast("long"), n_last)).alias("i"))
    i = F.col("i")
    url = F.col("url")
    if url_variant:
        url = F.when(i % 2 == 1, F.concat(url, F.lit("#s"), i.cast("string"))).otherwise(url)
    out = x.select(
        (F.col("id") * CHUNK_ID_FACTOR + i).alias("id"),
        "user_id",
        url.alias("url"),
        "title",
        (F.col("timestamp") + i * AUTOSAVE_MS + idiv(i, 7) * 36000 + idiv(i, 20) * 130000)
        .alias("timestamp"),
        F.least(F.lit(AUTOSAVE_MS).cast("long"), F.col("duration") - i * AUTOSAVE_MS)
        .alias("duration"),
    )
    return out.filter(F.col("duration") >= MIN_CHUNK_MS)


def chunks(spark: SparkSession, base: str, url_variant: bool = False) -> DataFrame:
    """Chunk stream: id, user_id, url, title, timestamp, duration."""
    return expand_chunks(sessions(spark, base), url_variant)


def spread_chunks(spark: SparkSession, base: str) -> DataFrame:
    """The rows of ``chunks`` for scans that sort them: sessions are dealt by user and 32 days into parts of about
    ``SESSIONS_A_PART`` before they become many chunks each, so a task's rows do not follow the size of a file's split."""
    s = sessions(spark, base)
    parts = max(8, -(-s.count() // SESSIONS_A_PART))
    span = idiv(F.col("timestamp"), 32 * DAY_MS)
    return expand_chunks(s.repartition(parts, F.pmod(F.xxhash64("user_id", span), F.lit(parts))))


def tab_events(spark: SparkSession, base: str) -> DataFrame:
    """Raw tab events: event_id, user_id, ts_ms, kind, tab_id, url, title."""
    ev = _events(spark, base).withColumn("_site", site_id(F.col("props")))
    kind = F.create_map(*[F.lit(x) for kv in EVENT_KIND.items() for x in kv])
    ts = ntz_to_ms(F.col("ts"))
    return ev.select(
        F.col("event_id"),
        F.col("user_id"),
        (F.lit(EPOCH_2024_MS) + idiv(ts - F.lit(EPOCH_2024_MS), TAB_TIME_COMPRESSION))
        .alias("ts_ms"),
        kind[F.col("event_type")].alias("kind"),
        (F.col("event_id") % 5).alias("tab_id"),
        site_url().alias("url"),
        site_title().alias("title"),
    )


def session_vectors(spark: SparkSession, base: str) -> DataFrame:
    """Vectors keyed by session id, metadata from the categorised session."""
    from tabtrail.operators.retrieval import vector_records
    emb = read_table(spark, base, "embeddings").select("vec_id", "embedding")
    s = categorized_sessions(spark, base)
    c = categories(spark)
    return vector_records(emb, s, c)


def question_vectors(spark: SparkSession, base: str) -> DataFrame:
    """Questions over all vectors: every embedding whose id is divisible by 100."""
    emb = read_table(spark, base, "embeddings")
    return emb.filter(F.col("vec_id") % 100 == 0).select(
        F.col("vec_id").alias("question_id"), F.col("embedding").alias("query_vec"))


def user_question_vectors(spark: SparkSession, base: str) -> DataFrame:
    """One question per user over the user's own vectors: the embedding with the user's id."""
    emb = read_table(spark, base, "embeddings")
    users = _events(spark, base).select("user_id").distinct()
    return users.join(emb, users["user_id"] == emb["vec_id"]).select(
        F.col("user_id").alias("question_id"), "user_id", F.col("embedding").alias("query_vec"))


def reflections(spark: SparkSession, base: str) -> DataFrame:
    """Question/answer pairs: each user turn with the next turn if that is the assistant's."""
    conv = read_table(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = conv.select("conv_id", "turn", "role", "text",
                    F.lead("role").over(w).alias("next_role"),
                    F.lead("text").over(w).alias("next_text"))
    x = x.filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    rid = F.col("conv_id") * 1000 + F.col("turn")
    return x.select(
        rid.alias("id"),
        (F.col("conv_id") % 15).alias("user_id"),
        F.col("text").alias("query"),
        F.col("next_text").alias("response"),
        (F.lit(EPOCH_2024_MS) + rid * 1000).alias("timestamp"),
    )


def pages(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "pages").select("page_id", "url")
