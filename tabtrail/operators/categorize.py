"""Session categorisation: URL rules, pluggable fallback classifier, backfill.

* ``categorize_by_rules`` (C1): first matching rule -> category name -> id by exact name
  lookup in the dimension. No rule or unknown name -> null.
* ``categorize`` (C1 + C2): rows still without an id go to the fallback. The default fallback
  is a ``CASE`` over url and title: one scan and no exchange of the sessions. A plugged
  classifier sees only the *distinct* (url, title) pairs of the unmatched rows
  (``mapInPandas``, Arrow batches), and only unmatched rows are joined back.
* ``categorize_backfill`` (C3) / ``categorize_summary`` (A13) / ``rule_coverage`` (C5).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrail.constants import BACKLOG_LIMIT, DEFAULT_CATEGORY_NAME
from tabtrail.functions.rules import with_rule_category
from tabtrail.session import ship_package


def _name_to_id(c: DataFrame) -> DataFrame:
    return c.select(F.col("name").alias("_cat_name"), F.col("id").alias("_cat_id"))


def categorize_by_rules(s: DataFrame, c: DataFrame) -> DataFrame:
    """Set ``category_id`` from the URL rules; other columns unchanged."""
    cols = [x for x in s.columns if x != "category_id"]
    x = with_rule_category(s, "url", "_rule_name")
    # coalesce: no category is named '' (names are required), and a non-nullable key
    # keeps Catalyst from inferring ``isnotnull(rule)`` when a later filter on
    # category_id turns this into an inner join -- that inferred filter would be pushed
    # below the projection and inline the lower-cased URL into every rule test
    x = x.join(_name_to_id(c), F.coalesce(F.col("_rule_name"), F.lit("")) == F.col("_cat_name"),
               "left")
    return x.select(*cols, F.col("_cat_id").alias("category_id"))


# ---------------------------------------------------------------------------
# Fallback classifier (C2): a deterministic keyword rule set by default.
# ---------------------------------------------------------------------------

# FIXED VALUES: default offline fallback rules (keywords after the classifier guidance).
FALLBACK_TECH_WORDS = ["docs", "documentation", "api", "reference", "guide", "manual", "tutorial",
                       "developer", "stack", "github"]
FALLBACK_SOCIAL_HOSTS = ["facebook", "instagram", "twitter", "x.com", "linkedin", "reddit",
                         "discord", "tiktok", "snapchat", "pinterest"]
FALLBACK_LEARNING_TITLE_WORDS = ["tutorial", "course", "lesson", "learn", "how to"]


def fallback_rule(url: Column, title: Column) -> Column:
    """Keyword fallback: technical pages -> Research, social hosts -> Mindless Scroll,
    YouTube by title (Learning / Relaxation), everything else -> Uncategorized."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))

    def any_of(col, words):
        found = F.contains(col, F.lit(words[0]))
        for w in words[1:]:
            found = found | F.contains(col, F.lit(w))
        return found

    youtube = any_of(u, ["youtube.com", "youtu.be"])
    tech = any_of(u, FALLBACK_TECH_WORDS) | any_of(t, FALLBACK_TECH_WORDS)
    return (F.when(youtube & any_of(t, FALLBACK_LEARNING_TITLE_WORDS), F.lit("Learning"))
            .when(youtube & ~tech, F.lit("Relaxation")).when(tech, F.lit("Research"))
            .when(any_of(u, FALLBACK_SOCIAL_HOSTS), F.lit("Mindless Scroll"))
            .otherwise(F.lit(DEFAULT_CATEGORY_NAME)))


class FAILED:
    """Result of a row on which a plugged function raised (a class: the same object in every
    worker)."""


def row_by_row(fn, pdf: pd.DataFrame) -> list:
    """Results of ``fn`` (a frame -> a series) for each row; a whole batch first, and if that
    raises each row alone, so that one bad row costs only its own result (``FAILED``)."""
    try:
        return list(fn(pdf))
    except Exception:  # noqa: BLE001 - a plugged function may raise anything
        out = []
        for i in range(len(pdf)):
            try:
                out.append(list(fn(pdf.iloc[i:i + 1]))[0])
            except Exception:  # noqa: BLE001
                out.append(FAILED)
        return out




def _classify_partitions(classifier: Callable[[pd.DataFrame], pd.Series]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = row_by_row(classifier, pdf[["url", "title"]])
            yield pd.DataFrame({"url": pdf["url"], "title": pdf["title"],
                                "_fb_name": pd.Series([None if n is FAILED or pd.isna(n) else str(n).strip() for n in names],
                                                      index=pdf.index, dtype=object),
                                "_fb_error": [n is FAILED for n in names]})
    return run


_FALLBACK_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("_fb_name", T.StringType()), T.StructField("_fb_error", T.BooleanType()),
])


def fallback_names(s: DataFrame, c: DataFrame,
                   classifier: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Classify the distinct (url, title) pairs of rows without ``category_id``.

    Returns url, title, name (trimmed classifier output; 'Uncategorized' when the
    classifier raised) and category_id (exact name lookup, null when unknown).
    """
    pending = s.filter(F.col("category_id").isNull()).select("url", "title").distinct()
    if classifier is None:
        named = pending.withColumn("name", fallback_rule(F.col("url"), F.col("title")))
    else:
        ship_package(s.sparkSession)
        classified = pending.mapInPandas(_classify_partitions(classifier), _FALLBACK_SCHEMA)
        named = classified.withColumn("name", F.when(
            F.col("_fb_error"), F.lit(DEFAULT_CATEGORY_NAME)).otherwise(F.col("_fb_name")))
    return (named.join(_name_to_id(c), F.col("name") == F.col("_cat_name"), "left")
            .select("url", "title", "name", F.col("_cat_id").alias("category_id")))


def categorize(s: DataFrame, c: DataFrame,
               classifier: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Rules first, then the classifier on distinct unmatched (url, title) pairs.

    Classifier returns a category *name* per row; it is trimmed and looked up by exact
    name (unknown -> null). A classifier error gives the id of 'Uncategorized'.
    """
    ruled = categorize_by_rules(s, c)
    cols = ruled.columns
    if classifier is None:
        names = c.select(F.col("name").alias("_fb_name"), F.col("id").alias("_fb_id"))
        name = F.when(F.col("category_id").isNull(), fallback_rule(F.col("url"), F.col("title")))
        joined = ruled.withColumn("_fb", F.coalesce(name, F.lit(""))).join(
            names, F.col("_fb") == F.col("_fb_name"), "left")
        return joined.select(*[F.coalesce(F.col("category_id"), F.col("_fb_id")).alias(x)
                               if x == "category_id" else F.col(x) for x in cols])
    fb = fallback_names(ruled, c, classifier).select(
        F.col("url").alias("_fb_url"), F.col("title").alias("_fb_title"),
        F.col("category_id").alias("_fb_id"))
    open_rows = ruled.filter(F.col("category_id").isNull())
    filled = open_rows.join(fb, F.col("url").eqNullSafe(F.col("_fb_url"))
                            & F.col("title").eqNullSafe(F.col("_fb_title")), "left")
    filled = filled.select(*[F.col("_fb_id").alias(x) if x == "category_id" else F.col(x) for x in cols])
    return ruled.filter(F.col("category_id").isNotNull()).unionByName(filled)


def categorize_backfill(s: DataFrame, c: DataFrame, classifier=None,
                        limit: int | None = None, keys=("user_id",)) -> DataFrame:
    """Backlog rows (no category), categorised; with ``limit`` only the newest per key.

    Returns the backlog rows with ``new_category_id`` and ``updated`` (id found).
    """
    backlog = uncategorized_backlog(s, limit, keys)
    done = categorize(backlog, c, classifier)
    return done.select(*[F.col(x) for x in backlog.columns if x != "category_id"],
                       F.col("category_id").alias("new_category_id"),
                       F.col("category_id").isNotNull().alias("updated"))


def uncategorized_backlog(s: DataFrame, limit: int | None = BACKLOG_LIMIT,
                          keys=("user_id",)) -> DataFrame:
    """Rows with ``category_id IS NULL``, newest first, top ``limit`` per key."""
    b = s.filter(F.col("category_id").isNull())
    if limit is None:
        return b
    w = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return b.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def categorize_summary(backfilled: DataFrame, keys=("user_id",)) -> DataFrame:
    """Per key: how many backlog rows got a category, and the backlog size."""
    return backfilled.groupBy(*keys).agg(
        F.count_if(F.col("updated")).alias("categorized"),
        F.count(F.lit(1)).alias("total"))


def rule_coverage(s: DataFrame) -> DataFrame:
    """Per rule category (null = unmatched): distinct sites, sessions, time, share of rows."""
    x = with_rule_category(s.select("url", "duration"), "url", "_rule").select(
        F.coalesce(F.col("_rule"), F.lit("(no rule)")).alias("rule"), "url", "duration")
    agg = x.groupBy("rule").agg(F.count_distinct("url").alias("sites"),
                                F.count(F.lit(1)).alias("sessions"),
                                F.sum("duration").alias("total_time"))
    # the share's denominator spans all groups; there are at most (#categories + 1)
    # aggregated rows here, so this single-partition window is bounded by the rule list
    total = F.sum("sessions").over(Window.partitionBy())
    return agg.select("rule", "sites", "sessions", "total_time",
                      (F.col("sessions") / total).alias("row_share"))
