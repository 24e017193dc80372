"""Registered listing, statistics, wellness and rule queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabtrail.constants import DAY_MS
from tabtrail.functions import formats as fm
from tabtrail.functions.rules import is_internal_url
from tabtrail.functions.urls import domain, normalize_url
from tabtrail.operators import categorize as cz
from tabtrail.operators import stats as st
from tabtrail.plans.oracle import (
    NOW,
    T0,
    T1,
    domain_sql,
    fixed_sql,
    format_clock_sql,
    format_hm_sql,
    format_hms_sql,
    internal_cond,
    normalize_sql,
    rule_case,
    wellness_case,
    with_prelude,
)
from tabtrail.plans.registry import register
from tabtrail.sources import fixtures as fx
from tabtrail.sources import sinks, stored

START = fx.EPOCH_2024_MS
WEEK_START = NOW - 7 * DAY_MS


def _s(spark, d, start=None, end=None):
    return fx.categorized_sessions(spark, d, start, end)


def _c(spark):
    return fx.categories(spark)


# --------------------------------------------------------------------------- wellness
_TIMES_SQL = f"""
{{p}}wt AS (SELECT *, {wellness_case('cname')} AS wtype FROM sj),
{{p}}t AS (
  SELECT user_id, {{group}} AS date,
    CAST(sum(CASE WHEN wtype = 'productive' THEN duration ELSE 0 END) AS BIGINT) AS focus_time,
    CAST(sum(CASE WHEN wtype = 'growth' THEN duration ELSE 0 END) AS BIGINT) AS learning_time,
    CAST(sum(CASE WHEN wtype = 'rest' THEN duration ELSE 0 END) AS BIGINT) AS rest_time,
    CAST(sum(CASE WHEN wtype = 'social' THEN duration ELSE 0 END) AS BIGINT) AS social_time,
    CAST(sum(CASE WHEN wtype = 'drain' THEN duration ELSE 0 END) AS BIGINT) AS mindless_time,
    CAST(sum(duration) AS BIGINT) AS total_time
  FROM {{p}}wt {{where}} GROUP BY 1, 2)
"""


def times_ctes(group: str, where: str = "", prefix: str = "") -> str:
    return _TIMES_SQL.format(group=group, where=where, p=prefix)

_SCORE_SQL = """CASE WHEN total_time = 0 THEN 0 ELSE CAST(greatest(0, least(100, floor(
  100.0::DOUBLE
  - abs(0.35::DOUBLE - focus_time::DOUBLE / total_time::DOUBLE) * 100.0::DOUBLE
  - abs(0.25::DOUBLE - learning_time::DOUBLE / total_time::DOUBLE) * 100.0::DOUBLE
  - abs(0.25::DOUBLE - rest_time::DOUBLE / total_time::DOUBLE) * 100.0::DOUBLE
  - abs(0.15::DOUBLE - social_time::DOUBLE / total_time::DOUBLE) * 100.0::DOUBLE
  - (mindless_time::DOUBLE / total_time::DOUBLE) * 30.0::DOUBLE
  + 0.5::DOUBLE))) AS BIGINT) END"""

_LABEL_SQL = ("CASE WHEN score >= 70 THEN 'Great balance!' WHEN score >= 50 "
              "THEN 'Room for improvement' ELSE 'Consider rebalancing' END")

_DAY = "strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d')"

WELLNESS_DAILY_SQL = with_prelude(f"""
SELECT user_id, date, score, {_LABEL_SQL} AS label, focus_time, learning_time, rest_time,
       social_time, mindless_time, total_time
FROM (SELECT *, {_SCORE_SQL} AS score FROM t)""", times_ctes(_DAY))


@register("wellness_daily", WELLNESS_DAILY_SQL)
def q_wellness_daily(spark, d):
    return st.wellness_daily(_s(spark, d), _c(spark))


@register("wellness_history", with_prelude(f"""
SELECT user_id, date, score, label, focus_time, learning_time, rest_time, social_time,
       mindless_time, total_time FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS rn FROM (
    SELECT user_id, date, score, {_LABEL_SQL} AS label, focus_time, learning_time, rest_time,
           social_time, mindless_time, total_time
    FROM (SELECT *, {_SCORE_SQL} AS score FROM t))) WHERE rn <= 7""",
    times_ctes(_DAY)))
def q_wellness_history(spark, d):
    return st.wellness_history(st.wellness_daily(_s(spark, d), _c(spark)))


@register("focus_rest_ratio", with_prelude(f"""
SELECT user_id, date, focus_time + learning_time AS focus_time, rest_time,
  CASE WHEN rest_time = 0 THEN (CASE WHEN focus_time + learning_time > 0 THEN 'Infinity'
       ELSE '0:0' END)
       ELSE {fixed_sql('focus_time + learning_time', 'rest_time', 2)} END AS ratio
FROM t""", times_ctes(_DAY)))
def q_focus_rest_ratio(spark, d):
    return st.focus_rest_ratio(_s(spark, d), _c(spark))


@register("today_stats", with_prelude(f"""
SELECT u.user_id, coalesce(r.runs, 0) AS session_count, coalesce(t.total_time, 0) AS total_time,
       CASE WHEN t.user_id IS NOT NULL THEN {_SCORE_SQL} END AS wellness_score
FROM (SELECT DISTINCT user_id FROM sessions_raw) u LEFT JOIN t ON t.user_id = u.user_id LEFT JOIN (
  SELECT user_id, count(*) FILTER (WHERE prev IS NULL OR prev <> cname) AS runs FROM (
    SELECT user_id, cname,
           lag(cname) OVER (PARTITION BY user_id ORDER BY timestamp, id) AS prev
    FROM sj WHERE timestamp >= {T0} AND timestamp <= {T1}) GROUP BY 1) r
ON r.user_id = u.user_id""",
    times_ctes("0", f"WHERE timestamp >= {T0} AND timestamp <= {T1}")))
def q_today_stats(spark, d):
    return st.today_stats(_s(spark, d, T0, T1), _c(spark), T0, T1, users=fx.sessions(spark, d))


@register("category_runs", with_prelude(f"""
SELECT user_id, date, count(*) FILTER (WHERE prev IS NULL OR prev <> cname) AS session_count
FROM (SELECT user_id, cname, {_DAY} AS date,
             lag(cname) OVER (PARTITION BY user_id, {_DAY} ORDER BY timestamp, id) AS prev
      FROM sj) GROUP BY 1, 2"""))
def q_category_runs(spark, d):
    return st.category_runs(_s(spark, d), _c(spark))


# --------------------------------------------------------------------------- categories
@register("today_categories", with_prelude(f"""
SELECT user_id, cname AS name, arg_min(ccolor, timestamp * 1000000 + id) AS color,
       CAST(sum(duration) AS BIGINT) AS time, count(*) AS count,
       row_number() OVER (PARTITION BY user_id ORDER BY sum(duration) DESC, cname) AS position
FROM sj WHERE timestamp >= {T0} AND timestamp <= {T1} GROUP BY 1, 2"""))
def q_today_categories(spark, d):
    return st.category_breakdown(_s(spark, d, T0, T1), _c(spark))


@register("category_stats", with_prelude(f"""
SELECT user_id, cname AS name, arg_min(ccolor, timestamp * 1000000 + id) AS color,
       arg_min(cwtype, timestamp * 1000000 + id) AS wellness_type,
       CAST(sum(duration) AS BIGINT) AS total_time, count(*) AS session_count,
       CAST(sum(duration) AS DOUBLE) / count(*) AS avg_duration,
       row_number() OVER (PARTITION BY user_id ORDER BY sum(duration) DESC, cname) AS position
FROM sj WHERE timestamp >= {START} AND timestamp <= {NOW} GROUP BY 1, 2"""))
def q_category_stats(spark, d):
    return st.category_stats(_s(spark, d, START, NOW), _c(spark), START, NOW)


@register("daily_stats", with_prelude(f"""
SELECT user_id, {_DAY} AS date, count(*) AS session_count,
       CAST(sum(duration) AS BIGINT) AS total_time,
       row_number() OVER (PARTITION BY user_id ORDER BY {_DAY}) AS position
FROM sessions WHERE timestamp >= {START} AND timestamp <= {NOW} GROUP BY 1, 2"""))
def q_daily_stats(spark, d):
    return st.daily_stats(_s(spark, d, START, NOW), START, NOW)


def _stored(spark, d):
    path = sinks.scratch_table(spark, "sessions-by-day")
    stored.append_by_day(fx.sessions(spark, d), path)
    return path


@register("stored_daily_stats", with_prelude(f"""
SELECT user_id, {_DAY} AS date, count(*) AS session_count,
       CAST(sum(duration) AS BIGINT) AS total_time,
       row_number() OVER (PARTITION BY user_id ORDER BY {_DAY}) AS position
FROM sessions WHERE timestamp >= {T0} AND timestamp <= {NOW} GROUP BY 1, 2"""))
def q_stored_daily_stats(spark, d):
    """A range of the table that appends by day have made; other days' folders are not read."""
    return st.daily_stats(stored.read_range(spark, _stored(spark, d), T0, NOW), T0, NOW)


@register("stored_user_weeks", with_prelude("""
SELECT user_id, l - 604800000 AS week_start, count(*) AS session_count, CAST(sum(duration) AS BIGINT) AS total_time
FROM sessions_raw JOIN (SELECT user_id, max(timestamp) AS l FROM sessions_raw WHERE user_id % 3 = 0 GROUP BY 1) USING (user_id)
WHERE timestamp BETWEEN l - 604800000 AND l GROUP BY 1, 2"""))
def q_stored_user_weeks(spark, d):
    """P1 with a range per user: the seven days up to the last session of every third user."""
    own = F.max("timestamp")
    ranges = fx.sessions(spark, d).filter(F.col("user_id") % 3 == 0).groupBy("user_id").agg(
        (own - 7 * DAY_MS).alias("start"), own.alias("end"))
    x = stored.in_ranges(stored.read_range(spark, _stored(spark, d)), ranges)
    return x.groupBy("user_id", F.col("start").alias("week_start")).agg(
        F.count(F.lit(1)).alias("session_count"), F.sum("duration").alias("total_time"))


_SUMMARY_SQL = f"""
g AS (
  SELECT user_id, cname AS name, arg_min(cwtype, timestamp * 1000000 + id) AS wellness_type,
         CAST(sum(duration) AS BIGINT) AS time, count(*) AS session_count
  FROM sj WHERE timestamp >= {T0} AND timestamp <= {T1} GROUP BY 1, 2),
a AS (
  SELECT *, CAST(sum(time) OVER (PARTITION BY user_id) AS BIGINT) AS total_time,
         row_number() OVER (PARTITION BY user_id ORDER BY time DESC, name) AS position,
         first_value(name) OVER (PARTITION BY user_id ORDER BY time DESC, name) AS top_category
  FROM g),
summary AS (
  SELECT user_id, name, time, {format_hm_sql('time')} AS time_text, wellness_type,
         session_count, total_time, {fixed_sql('time', 'total_time', 1, 100)} AS percentage,
         {format_hm_sql('total_time')} AS total_text, top_category, position
  FROM a)
"""


@register("activity_summary", with_prelude("SELECT * FROM summary", _SUMMARY_SQL))
def q_activity_summary(spark, d):
    return st.activity_summary(_s(spark, d, T0, T1), _c(spark))


@register("activity_lines", with_prelude("""
SELECT user_id, any_value(total_text) AS total_text,
       CAST(sum(session_count) AS BIGINT) AS session_count,
       string_agg('- ' || name || ': ' || time_text || ' (' || percentage || '%) - '
                  || CAST(session_count AS VARCHAR) || ' sessions - Type: ' || wellness_type,
                  chr(10) ORDER BY position) AS lines
FROM summary GROUP BY 1""", _SUMMARY_SQL))
def q_activity_lines(spark, d):
    return st.activity_lines(st.activity_summary(_s(spark, d, T0, T1), _c(spark)))


@register("learning_sessions", with_prelude(f"""
SELECT user_id, cname AS name, CAST(sum(duration) AS BIGINT) AS total_time,
       count(*) AS session_count
FROM sj WHERE timestamp >= {WEEK_START} AND {wellness_case('cname')} = 'growth'
GROUP BY 1, 2"""))
def q_learning_sessions(spark, d):
    return st.learning_sessions(_s(spark, d, WEEK_START), _c(spark), WEEK_START)


@register("domain_time", with_prelude(f"""
SELECT user_id, {domain_sql('url')} AS domain, CAST(sum(duration) AS BIGINT) AS total_time,
       count(*) AS session_count
FROM sessions GROUP BY 1, 2"""))
def q_domain_time(spark, d):
    return st.domain_time(_s(spark, d))


def _range_sql():
    starts = {n: st.range_start(n, NOW) for n in st.RANGE_NAMES}
    sel = ", ".join(
        f"count(*) FILTER (WHERE timestamp >= {v}) AS n_{k}, "
        f"CAST(coalesce(sum(duration) FILTER (WHERE timestamp >= {v}), 0) AS BIGINT) AS t_{k}"
        for k, v in starts.items())
    union = " UNION ALL ".join(
        f"SELECT user_id, '{k}' AS range_name, CAST({v} AS BIGINT) AS range_start, "
        f"n_{k} AS session_count, t_{k} AS total_time FROM g" for k, v in starts.items())
    return with_prelude(union, f"g AS (SELECT user_id, {sel} FROM sessions GROUP BY 1)")


@register("range_windows", _range_sql())
def q_range_windows(spark, d):
    return st.range_windows(_s(spark, d), NOW)


# --------------------------------------------------------------------------- listing
_LIST_COLS = ("id, user_id, url, title, duration, timestamp, category_id, "
              "nullif(cn, '') AS category_name, nullif(cc, '') AS category_color")


def _listing_sql(where: str, limit: int) -> str:
    return with_prelude(f"""
SELECT {_LIST_COLS} FROM (
  SELECT s.*, c.name AS cn, c.color AS cc,
         row_number() OVER (PARTITION BY s.user_id ORDER BY s.timestamp DESC, s.id DESC) AS rn
  FROM sessions s LEFT JOIN cats c ON c.id = s.category_id {where}) WHERE rn <= {limit}""")


@register("sessions_listing", _listing_sql("", 100))
def q_sessions_listing(spark, d):
    return st.list_sessions(_s(spark, d), _c(spark))


@register("sessions_by_category",
          _listing_sql(f"WHERE s.category_id = 2 AND s.timestamp >= {START} "
                       f"AND s.timestamp <= {NOW}", 100))
def q_sessions_by_category(spark, d):
    return st.list_sessions(_s(spark, d, START, NOW), _c(spark), START, NOW, category_id=2)


@register("session_by_id", with_prelude(f"""
SELECT s.id, s.user_id, s.url, s.title, s.duration, s.timestamp, s.category_id,
       nullif(c.name, '') AS category_name, nullif(c.color, '') AS category_color
FROM sessions s LEFT JOIN cats c ON c.id = s.category_id WHERE s.id = 4242"""))
def q_session_by_id(spark, d):
    return st.session_by_id(_s(spark, d), _c(spark), 4242)


@register("uncategorized_backlog", with_prelude("""
SELECT id, user_id, url, title, duration, timestamp, category_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS rn
  FROM sessions WHERE category_id IS NULL) WHERE rn <= 50"""))
def q_uncategorized_backlog(spark, d):
    return cz.uncategorized_backlog(_s(spark, d))


@register("external_sessions", with_prelude(f"""
SELECT id, user_id, url, title, duration, timestamp FROM sessions_raw
WHERE NOT {internal_cond('url')}"""))
def q_external_sessions(spark, d):
    s = fx.sessions(spark, d)
    return s.filter(~is_internal_url(F.col("url"))).select(
        "id", "user_id", "url", "title", "duration", "timestamp")


# --------------------------------------------------------------------------- scalars
@register("categorize_by_url", with_prelude(f"""
SELECT id, url, {rule_case('url')} AS category FROM sessions_raw"""))
def q_categorize_by_url(spark, d):
    from tabtrail.functions.rules import with_rule_category
    s = fx.sessions(spark, d).select("id", "url")
    return with_rule_category(s, "url", "category")


@register("format_times", with_prelude(f"""
SELECT id, duration, {format_hm_sql('duration')} AS hm, {format_hms_sql('duration')} AS hms,
       {format_clock_sql('duration')} AS clock,
       CAST(floor(duration / 60000.0 + 0.5) AS BIGINT) AS minutes
FROM sessions_raw"""))
def q_format_times(spark, d):
    s = fx.sessions(spark, d)
    x = F.col("duration")
    return s.select("id", "duration", fm.format_hm(x).alias("hm"), fm.format_hms(x).alias("hms"),
                    fm.format_clock(x).alias("clock"), fm.minutes_rounded(x).alias("minutes"))


@register("normalize_urls", with_prelude(f"""
SELECT page_id, url, {normalize_sql('url')} AS normalized, {domain_sql('url')} AS domain
FROM pages"""))
def q_normalize_urls(spark, d):
    p = fx.pages(spark, d)
    return p.select("page_id", "url", normalize_url(F.col("url")).alias("normalized"),
                    domain(F.col("url")).alias("domain"))


@register("rule_coverage", with_prelude(f"""
SELECT rule, sites, sessions, total_time, sessions::DOUBLE / sum(sessions) OVER () AS row_share
FROM (SELECT coalesce({rule_case('url')}, '(no rule)') AS rule, count(DISTINCT url) AS sites,
             count(*) AS sessions, CAST(sum(duration) AS BIGINT) AS total_time
      FROM sessions_raw GROUP BY 1)"""))
def q_rule_coverage(spark, d):
    return cz.rule_coverage(fx.sessions(spark, d))
