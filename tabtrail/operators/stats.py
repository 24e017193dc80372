"""Listing, statistics and wellness operators.

Every operator takes the sessions and categories DataFrames and explicit time bounds
(``now`` and a time zone are arguments, never the wall clock). Results are per key
(``keys``, default ``("user_id",)``): the reference's single-user scalars become one row
per user. Aggregations are plain ``groupBy`` (partial + final hash aggregation, so a hot
user is combined map-side); the join with the category dimension is left to the planner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtrail.constants import (
    DAY_MS,
    DEFAULT_CATEGORY_COLOR,
    DEFAULT_CATEGORY_NAME,
    DEFAULT_WELLNESS_TYPE,
    DRAIN_PENALTY,
    IDEAL_SHARES,
    RANGE_DEFAULT_MS,
    RANGE_LENGTH_MS,
    SCORE_HISTORY_DAYS,
    SCORE_LABEL_LOW,
    SCORE_LABELS,
    SESSION_LIST_LIMIT,
)
from tabtrail.functions.formats import fixed_ratio, format_hm, js_round, percent_1
from tabtrail.functions.rules import wellness_type
from tabtrail.functions.time import day_string
from tabtrail.operators.ordered import with_neighbour, with_rank

KEYS = ("user_id",)


def _default(col: Column, value: str) -> Column:
    """JavaScript ``x || default`` for strings: null and '' both fall back."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(value))


def with_category(s: DataFrame, c: DataFrame, fields=("name", "color", "wellness_type"),
                  raw: bool = False) -> DataFrame:
    """Left join sessions -> categories on ``category_id``; adds ``category_<f>``.

    With ``raw=False`` the defaults 'Uncategorized' / '#9E9E9E' / 'unknown' apply.
    """
    dim = c.select(F.col("id").alias("_cid"),
                   *[F.col(f).alias("_c_" + f) for f in fields])
    x = s.join(dim, s["category_id"] == F.col("_cid"), "left")
    defaults = {"name": DEFAULT_CATEGORY_NAME, "color": DEFAULT_CATEGORY_COLOR,
                "wellness_type": DEFAULT_WELLNESS_TYPE}
    out = [F.col(x_) for x_ in s.columns]
    for f in fields:
        v = F.col("_c_" + f)
        if raw:
            out.append(F.nullif(v, F.lit("")).alias("category_" + f))
        else:
            out.append(_default(v, defaults.get(f, "")).alias("category_" + f))
    return x.select(*out)


def in_range(s: DataFrame, start: int | None = None, end: int | None = None,
             col: str = "timestamp") -> DataFrame:
    """Inclusive bounds, each optional. On a stored ``timestamp`` column they are pushed into
    the scan; sources that derive it take the bounds themselves."""
    if start is not None:
        s = s.filter(F.col(col) >= F.lit(start))
    if end is not None:
        s = s.filter(F.col(col) <= F.lit(end))
    return s


def top_n(df: DataFrame, n: int | None, order: Sequence[Column],
          keys: Sequence[str] = KEYS, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order`` (``row_number``; Spark applies the limit
    per map partition before the shuffle, so a hot key ships at most ``n`` rows per
    partition)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn(rank_col or "_rn", F.row_number().over(w).cast("long"))
    if n is not None:
        x = x.filter(F.col(rank_col or "_rn") <= n)
    return x if rank_col else x.drop("_rn")


# ---------------------------------------------------------------------------
# Listing (S1, P1, P2, P3, P8, J1, L1)
# ---------------------------------------------------------------------------

def list_sessions(s: DataFrame, c: DataFrame, start: int | None = None,
                  end: int | None = None, category_id: int | None = None,
                  limit: int | None = SESSION_LIST_LIMIT, keys=KEYS) -> DataFrame:
    """Newest sessions first (top ``limit`` per key) with flattened category fields."""
    x = in_range(s, start, end)
    if category_id is not None:
        x = x.filter(F.col("category_id") == F.lit(category_id))
    x = top_n(x, limit, [F.col("timestamp").desc(), F.col("id").desc()], keys)
    x = with_category(x, c, ("name", "color"), raw=True)
    return x


def session_by_id(s: DataFrame, c: DataFrame, session_id: int) -> DataFrame:
    """One session with category fields (empty when absent)."""
    return with_category(s.filter(F.col("id") == F.lit(session_id)), c, ("name", "color"),
                         raw=True)


# ---------------------------------------------------------------------------
# Category aggregates
# ---------------------------------------------------------------------------

def _by_category(x: DataFrame, keys, attrs: dict[str, str]) -> DataFrame:
    """Per key and category name: time, rows, and attributes of the name's first row.

    Stage 1 is a hash aggregation on (key, name, attributes) -- string grouping keys and
    numeric buffers keep it hash-based with map-side combine over the whole fact table;
    stage 2 picks, per (key, name), the attributes of the group holding the earliest
    row, on the already aggregated (tiny) data. Names are unique in the dimension, so
    attributes vary within a name only between a real category and the default group.
    """
    g = x.groupBy(*keys, F.col("category_name").alias("name"),
                  *[F.col(src).alias(dst) for dst, src in attrs.items()]).agg(
        F.sum("duration").alias("_t"), F.count(F.lit(1)).alias("_n"),
        F.min("timestamp").alias("_ts0"))
    return g.groupBy(*keys, "name").agg(
        *[F.min_by(dst, F.struct("_ts0", dst)).alias(dst) for dst in attrs],
        F.sum("_t").alias("_t"), F.sum("_n").alias("_n"))


def category_breakdown(s: DataFrame, c: DataFrame, keys=KEYS) -> DataFrame:
    """A2: per key and category name: color of the first row, time, row count."""
    x = with_category(s, c)
    g = _by_category(x, keys, {"color": "category_color"})
    return g.select(*keys, "name", "color", F.col("_t").alias("time"), F.col("_n").alias("count"),
                    _position(keys, F.col("_t").desc(), F.col("name")))


def _position(keys, *order: Column) -> Column:
    """Place of a row in its key's list (over aggregated rows: few per key)."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long").alias("position")


def category_stats(s: DataFrame, c: DataFrame, start: int | None = None,
                   end: int | None = None, keys=KEYS) -> DataFrame:
    """A3: totals, count and average per category (filter only when both bounds)."""
    x = in_range(s, start, end) if (start is not None and end is not None) else s
    x = with_category(x, c)
    g = _by_category(x, keys, {"color": "category_color", "wellness_type": "category_wellness_type"})
    return g.select(*keys, "name", "color", "wellness_type", F.col("_t").alias("total_time"),
                    F.col("_n").alias("session_count"),
                    (F.col("_t") / F.col("_n")).alias("avg_duration"),
                    _position(keys, F.col("_t").desc(), F.col("name")))


def daily_stats(s: DataFrame, start: int, end: int, keys=KEYS) -> DataFrame:
    """A4: per key and UTC day: row count and total time, inclusive bounds."""
    x = in_range(s, start, end)
    g = x.groupBy(*keys, day_string(F.col("timestamp")).alias("date")).agg(
        F.count(F.lit(1)).alias("session_count"),
        F.sum("duration").alias("total_time"))
    return g.select("*", _position(keys, F.col("date")))


def activity_summary(s: DataFrame, c: DataFrame, keys=KEYS) -> DataFrame:
    """Per category formatted time, share (1 decimal), wellness type (table
    column), count; plus the key's total and its top category (largest time, then
    name)."""
    x = with_category(s, c)
    g = _by_category(x, keys, {"wellness_type": "category_wellness_type"}).select(
        *keys, "name", "wellness_type", F.col("_t").alias("time"),
        F.col("_n").alias("session_count"))
    wk = Window.partitionBy(*keys)
    wr = wk.orderBy(F.col("time").desc(), F.col("name"))
    total = F.sum("time").over(wk)
    return g.select(
        *keys, "name", "time", format_hm(F.col("time")).alias("time_text"),
        "wellness_type", "session_count",
        total.alias("total_time"),
        percent_1(F.col("time"), total).alias("percentage"),
        format_hm(total).alias("total_text"),
        F.first("name").over(wr.rowsBetween(Window.unboundedPreceding,
                                            Window.unboundedFollowing)).alias("top_category"),
        F.row_number().over(wr).cast("long").alias("position"))


def activity_lines(summary: DataFrame, keys=KEYS) -> DataFrame:
    """The prompt lines ``- name: time (pct%) - n sessions - Type: t``, in order."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("time_text"), F.lit(" ("),
                    F.col("percentage"), F.lit("%) - "), F.col("session_count").cast("string"),
                    F.lit(" sessions - Type: "), F.col("wellness_type"))
    g = summary.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("position"), line.alias("l")))).alias("_ls"),
        F.first("total_text").alias("total_text"),
        F.sum("session_count").alias("session_count"))
    return g.select(*keys, "total_text", "session_count",
                    F.array_join(F.transform("_ls", lambda e: e["l"]), "\n").alias("lines"))


# ---------------------------------------------------------------------------
# Runs and wellness
# ---------------------------------------------------------------------------

def category_runs(s: DataFrame, c: DataFrame, tz: str = "UTC", keys=KEYS) -> DataFrame:
    """Per key and day, number of runs of equal category name in time order."""
    x = with_category(s, c, ("name",)).withColumn("date", day_string(F.col("timestamp"), tz))
    part = [*keys, "date"]
    # keys include the day, so each window partition is already one key-day
    x = with_neighbour(x, part, ["timestamp", "id"], ["category_name"], "prev")
    x = x.withColumn("_new", F.col("prev_category_name").isNull()
                     | (F.col("prev_category_name") != F.col("category_name")))
    return x.groupBy(*part).agg(F.count_if("_new").alias("session_count"))


def wellness_times(s: DataFrame, c: DataFrame, group: Sequence[Column | str]) -> DataFrame:
    """Per group, time per wellness type of the category *name* and the total."""
    x = with_category(s, c, ("name",))
    wt = wellness_type(F.col("category_name"))
    def typed(t):
        return F.sum(F.when(wt == t, F.col("duration")).otherwise(F.lit(0))).alias(t)
    return x.groupBy(*group).agg(
        *[typed(t) for t in ("productive", "growth", "rest", "social", "drain")],
        F.sum("duration").alias("total_time"))


def wellness_score(times: DataFrame) -> Column:
    """F12 on the columns of ``wellness_times``: 0..100, 0 when the total is 0."""
    total = F.col("total_time").cast("double")
    score = F.lit(100.0)
    for t, ideal in IDEAL_SHARES:
        actual = F.col(t) / F.nullif(total, F.lit(0.0))
        score = score - F.abs(F.lit(ideal) - actual) * F.lit(100.0)
    score = score - (F.col("drain") / F.nullif(total, F.lit(0.0))) * F.lit(float(DRAIN_PENALTY))
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), js_round(score)))
    return F.when(F.col("total_time") == 0, F.lit(0).cast("long")) \
        .otherwise(clamped.cast("long"))


def score_label(score: Column) -> Column:
    """Dashboard label of a score."""
    expr = None
    for lo, text in SCORE_LABELS:
        cond = score >= lo
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr.otherwise(F.lit(SCORE_LABEL_LOW))


def wellness_daily(s: DataFrame, c: DataFrame, tz: str = "UTC", keys=KEYS) -> DataFrame:
    """A7/A8/F12/P11 per key and local day: score, label and the five times."""
    t = wellness_times(s, c, [*keys, day_string(F.col("timestamp"), tz).alias("date")])
    sc = wellness_score(t)
    return t.select(*keys, "date", sc.alias("score"), score_label(sc).alias("label"),
                    F.col("productive").alias("focus_time"),
                    F.col("growth").alias("learning_time"),
                    F.col("rest").alias("rest_time"),
                    F.col("social").alias("social_time"),
                    F.col("drain").alias("mindless_time"),
                    "total_time")


def focus_rest_ratio(s: DataFrame, c: DataFrame, tz: str = "UTC", keys=KEYS) -> DataFrame:
    """(productive + growth) / rest with two decimals; 'Infinity' / '0:0' at rest 0."""
    t = wellness_times(s, c, [*keys, day_string(F.col("timestamp"), tz).alias("date")])
    focus = F.col("productive") + F.col("growth")
    ratio = (F.when(F.col("rest") == 0,
                    F.when(focus > 0, F.lit("Infinity")).otherwise(F.lit("0:0")))
             .otherwise(fixed_ratio(focus, F.col("rest"), 2)))
    return t.select(*keys, "date", focus.alias("focus_time"), F.col("rest").alias("rest_time"),
                    ratio.alias("ratio"))


def wellness_history(daily: DataFrame, days: int = SCORE_HISTORY_DAYS, keys=KEYS) -> DataFrame:
    """L3: newest ``days`` score rows per key."""
    return top_n(daily, days, [F.col("date").desc()], keys)


def today_stats(s: DataFrame, c: DataFrame, day_start: int, day_end: int | None = None,
                tz: str = "UTC", keys=KEYS, users: DataFrame | None = None) -> DataFrame:
    """A1 + W1 + A8 for one day window: runs, total time and score per key. Keys of ``users``
    without a row in the window get 0 sessions, 0 time and a null score."""
    x = in_range(s, day_start, day_end)
    runs = category_runs(x, c, tz, keys).groupBy(*keys).agg(
        F.sum("session_count").alias("session_count"))
    t = wellness_times(x, c, list(keys))
    t = t.select(*keys, "total_time", wellness_score(t).alias("wellness_score"))
    if users is not None:
        t = users.select(*keys).distinct().join(t, list(keys), "left")
    return t.join(runs, list(keys), "left").select(
        *keys, F.coalesce("session_count", F.lit(0)).alias("session_count"),
        F.coalesce("total_time", F.lit(0)).alias("total_time"), "wellness_score")


# ---------------------------------------------------------------------------
# Named ranges (P10) and range-based views
# ---------------------------------------------------------------------------

def range_start(name: str, now_ms: int, tz: str = "UTC") -> int:
    """P10: start of a named range as epoch ms (driver-side scalar)."""
    import datetime as _dt
    from zoneinfo import ZoneInfo
    if name == "today":
        local = _dt.datetime.fromtimestamp(now_ms / 1000, ZoneInfo(tz))
        midnight = local.replace(hour=0, minute=0, second=0, microsecond=0)
        return int(midnight.timestamp() * 1000)
    return now_ms - RANGE_LENGTH_MS.get(name, RANGE_DEFAULT_MS)


RANGE_NAMES = ("today", "week", "month", "day")


def range_windows(s: DataFrame, now_ms: int, tz: str = "UTC", keys=KEYS) -> DataFrame:
    """Sessions and time per key in each named range (``timestamp >= start``), computed
    in one pass with conditional sums, then unpivoted."""
    starts = {n: range_start(n, now_ms, tz) for n in RANGE_NAMES}
    aggs = []
    for n, st in starts.items():
        inr = F.col("timestamp") >= F.lit(st)
        aggs += [F.count_if(inr).alias(f"n_{n}"),
                 F.sum(F.when(inr, F.col("duration")).otherwise(F.lit(0))).alias(f"t_{n}")]
    g = s.groupBy(*keys).agg(*aggs)
    stack = ", ".join(f"'{n}', {st}L, n_{n}, t_{n}" for n, st in starts.items())
    return g.selectExpr(*keys, f"stack({len(starts)}, {stack}) "
                               "as (range_name, range_start, session_count, total_time)")


def learning_sessions(s: DataFrame, c: DataFrame, start: int, keys=KEYS) -> DataFrame:
    """Growth-type categories (by name) since ``start``: time and count per category."""
    x = with_category(s.filter(F.col("timestamp") >= F.lit(start)), c, ("name",))
    x = x.filter(wellness_type(F.col("category_name")) == "growth")
    return x.groupBy(*keys, F.col("category_name").alias("name")).agg(
        F.sum("duration").alias("total_time"), F.count(F.lit(1)).alias("session_count"))


def domain_time(s: DataFrame, keys=KEYS) -> DataFrame:
    """Time and visits per host name."""
    from tabtrail.functions.urls import domain
    return s.groupBy(*keys, domain(F.col("url")).alias("domain")).agg(
        F.sum("duration").alias("total_time"), F.count(F.lit(1)).alias("session_count"))


def history_view(merged: DataFrame, term: str | None = None, sort_field: str = "recency",
                 order: str = "desc", keys=KEYS) -> DataFrame:
    """P7 + L2 on display-merged rows: case-insensitive search in title, url or domain
    (literal substring), a shown title (F14: title, else domain), and a position per key by
    recency or duration.

    A position is a rank over a key's whole history (``ordered.with_rank``), so neither a key nor a
    value that most rows share is the work of one task."""
    from tabtrail.functions.urls import with_url_parts
    x = with_url_parts(merged, "url", None, "_host")
    if term is not None and term.strip() != "":
        t = F.lit(term.lower())
        x = x.filter(F.contains(F.lower(F.coalesce(F.col("title"), F.lit(""))), t)
                     | F.contains(F.lower(F.coalesce(F.col("url"), F.lit(""))), t)
                     | F.contains(F.lower(F.coalesce(F.col("_host"), F.lit(""))), t))
    x = x.withColumn("shown_title", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("_host"))).drop("_host")
    v = F.coalesce(F.col("timestamp" if sort_field == "recency" else "duration"), F.lit(0))
    vo = v.desc() if order == "desc" else v.asc()
    x = with_rank(x, keys, [vo, F.col("timestamp").asc(), F.col("id").asc()])
    return x.select(*merged.columns, "shown_title", "position")
