"""Registered merge, capture and categorisation queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabtrail.constants import IDLE_AFTER_MS
from tabtrail.operators import capture as cp
from tabtrail.operators import categorize as cz
from tabtrail.operators import merge as mg
from tabtrail.operators import stats as st
from tabtrail.plans.oracle import (
    NOW,
    T0,
    T1,
    domain_sql,
    format_clock_sql,
    internal_cond,
    normalize_sql,
    rule_case,
    with_prelude,
)
from tabtrail.plans.registry import register
from tabtrail.sources import fixtures as fx

HISTORY_TERM = "Learn"

# --------------------------------------------------------------------------- merges
_CLEANUP_CTES = """
m2a AS (SELECT *, lag(timestamp + duration) OVER (PARTITION BY user_id, url ORDER BY timestamp, id)
          AS prev_end FROM chunks),
m2b AS (SELECT *, sum(CASE WHEN prev_end IS NULL OR timestamp - prev_end > 120000 THEN 1 ELSE 0 END)
          OVER (PARTITION BY user_id, url ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS g
        FROM m2a),
cleaned AS (
  SELECT first(id ORDER BY timestamp, id) AS id, user_id, url,
         first(title ORDER BY timestamp, id) AS title, min(timestamp) AS timestamp,
         CAST(sum(duration) AS BIGINT) AS duration, count(*) AS merged_rows
  FROM m2b GROUP BY user_id, url, g)
"""


@register("cleanup_duplicates", with_prelude("SELECT * FROM cleaned", _CLEANUP_CTES))
def q_cleanup_duplicates(spark, d):
    return mg.cleanup_duplicates(fx.chunks(spark, d))


@register("cleanup_summary", with_prelude("""
SELECT user_id, count(*) FILTER (WHERE merged_rows > 1) AS merged_groups,
       CAST(sum(merged_rows - 1) AS BIGINT) AS deleted_rows
FROM cleaned GROUP BY 1""", _CLEANUP_CTES))
def q_cleanup_summary(spark, d):
    return mg.cleanup_summary(mg.cleanup_duplicates(fx.chunks(spark, d)))


def _display_ctes(src: str, name: str = "merged") -> str:
    return f"""
{name}_a AS (SELECT *, {normalize_sql('url')} AS nurl FROM {src}),
{name}_b AS (SELECT *, lag(nurl) OVER w AS pn, lag(title) OVER w AS pt, lag(timestamp) OVER w AS pts
       FROM {name}_a WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id)),
{name}_c AS (SELECT *, sum(CASE WHEN pts IS NULL OR nurl IS DISTINCT FROM pn OR title IS DISTINCT FROM pt
                          OR timestamp - pts > 300000 THEN 1 ELSE 0 END)
         OVER (PARTITION BY user_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS g
       FROM {name}_b),
{name} AS (
  SELECT first(id ORDER BY timestamp, id) AS id, user_id,
         first(url ORDER BY timestamp, id) AS url, first(title ORDER BY timestamp, id) AS title,
         min(timestamp) AS timestamp, CAST(sum(duration) AS BIGINT) AS duration,
         CASE WHEN count(*) > 1 THEN count(*) END AS merged_count
  FROM {name}_c GROUP BY user_id, g)
"""


@register("display_merge", with_prelude("SELECT * FROM merged", _display_ctes("chunks_v")))
def q_display_merge(spark, d):
    return mg.display_merge(fx.chunks(spark, d, url_variant=True))


@register("merged_session_count", with_prelude(
    "SELECT user_id, count(*) AS merged_session_count FROM merged GROUP BY 1",
    f"""today AS (SELECT id, user_id, url, title, timestamp, duration
      FROM chunks_v WHERE timestamp >= {T0} AND timestamp <= {T1}),"""
    + _display_ctes("today")))
def q_merged_session_count(spark, d):
    today = st.in_range(fx.chunks(spark, d, url_variant=True), T0, T1)
    return mg.merged_session_count(mg.display_merge(today))


_t = HISTORY_TERM.lower()


@register("history_search", with_prelude(f"""
SELECT *, coalesce(nullif(title, ''), {domain_sql('url')}) AS shown_title,
       row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, timestamp, id) AS position
FROM merged
WHERE contains(lower(coalesce(title, '')), '{_t}') OR contains(lower(coalesce(url, '')), '{_t}')
   OR contains(lower(coalesce({domain_sql('url')}, '')), '{_t}')""", _display_ctes("chunks_v")))
def q_history_search(spark, d):
    c = fx.chunks(spark, d, url_variant=True)
    return st.history_view(mg.display_merge(c), HISTORY_TERM, "recency", "desc")


@register("history_sorted", with_prelude(f"""
SELECT *, coalesce(nullif(title, ''), {domain_sql('url')}) AS shown_title,
  row_number() OVER (PARTITION BY user_id ORDER BY coalesce(duration, 0) DESC, timestamp, id)
  AS position FROM merged""", _display_ctes("chunks_v")))
def q_history_sorted(spark, d):
    c = fx.chunks(spark, d, url_variant=True)
    return st.history_view(mg.display_merge(c), None, "duration", "desc")


@register("last_n_per_user", with_prelude("""
SELECT id, user_id, url, title, timestamp, duration FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS rn
  FROM chunks) WHERE rn <= 500"""))
def q_last_n_per_user(spark, d):
    return cp.last_n_per_user(fx.spread_chunks(spark, d))


# The oracle folds each island chunk by chunk in a recursive CTE whose state is the
# list of finished rows and the list of rows still inside the look-back.
_INGEST_CTES = """
m1a AS (SELECT *, lag(timestamp) OVER (PARTITION BY user_id, url ORDER BY timestamp, id) AS pts FROM chunks),
m1b AS (SELECT *, sum(CASE WHEN pts IS NULL OR timestamp - pts > 120000 THEN 1 ELSE 0 END)
          OVER (PARTITION BY user_id, url ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS isl FROM m1a),
m1c AS (SELECT *, row_number() OVER (PARTITION BY user_id, url, isl ORDER BY timestamp, id) AS rn FROM m1b),
fold AS (
  SELECT user_id, url, isl, rn,
         CAST([] AS STRUCT(ts BIGINT, id BIGINT, dur BIGINT, title VARCHAR, n BIGINT)[]) AS done,
         [struct_pack(ts := timestamp, id := id, dur := duration, title := title, n := 1::BIGINT)] AS live
  FROM m1c WHERE rn = 1
  UNION ALL
  SELECT user_id, url, isl, rn, done2 AS done,
         CASE WHEN len(lb) > 0 AND cts - (lb[1].ts + lb[1].dur) <= 35000
              THEN [struct_pack(ts := lb[1].ts, id := lb[1].id, dur := lb[1].dur + cdur,
                                title := lb[1].title, n := lb[1].n + 1)]
              ELSE list_concat(lb, [struct_pack(ts := cts, id := cid, dur := cdur, title := ctitle,
                                                n := 1::BIGINT)]) END AS live
  FROM (
    SELECT f.user_id, f.url, f.isl, c.rn, c.timestamp AS cts, c.id AS cid, c.duration AS cdur,
           c.title AS ctitle,
           list_concat(f.done, list_filter(f.live, lambda r: r.ts < c.timestamp - 120000)) AS done2,
           list_sort(list_filter(f.live, lambda r: r.ts >= c.timestamp - 120000)) AS lb
    FROM fold f JOIN m1c c ON c.user_id = f.user_id AND c.url = f.url AND c.isl = f.isl
                           AND c.rn = f.rn + 1))
"""


@register("ingest_merge", with_prelude("""
SELECT r.id AS id, user_id, url, r.title AS title, r.ts AS timestamp, r.dur AS duration,
       r.n AS merged_chunks, c.id AS category_id
FROM (SELECT user_id, url, unnest(list_concat(done, live)) AS r FROM fold
      QUALIFY row_number() OVER (PARTITION BY user_id, url, isl ORDER BY rn DESC) = 1)
LEFT JOIN cats c ON c.name = (""" + rule_case("url") + """)
""", _INGEST_CTES, recursive=True))
def q_ingest_merge(spark, d):
    # rows that ingest creates get the category of their URL rule
    return cz.categorize_by_rules(mg.ingest_merge(fx.chunks(spark, d)), fx.categories(spark))


# --------------------------------------------------------------------------- capture
_TAB_CTES = f"""
te_f AS (SELECT * FROM tab_events WHERE NOT (kind = 'focus_gained' AND {internal_cond('url')})),
te_g AS (SELECT *, CASE WHEN kind IN ('activated', 'url_updated', 'focus_gained')
                         AND NOT {internal_cond('url')} THEN url END AS state FROM te_f),
te_h AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS prev_state
         FROM te_g),
te_k AS (SELECT * FROM te_h WHERE NOT (kind = 'url_updated' AND coalesce(url = prev_state, false))),
te_m AS (SELECT *, lead(ts_ms) OVER w AS next_ts, lead(kind) OVER w AS next_kind
         FROM te_k WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)),
tab_sessions AS (
  SELECT user_id, event_id, url, title, tab_id, ts_ms AS start_ts, next_ts AS end_ts,
         next_ts - ts_ms AS elapsed_ms,
         (next_ts - ts_ms) // 30000 * 30000 +
           CASE WHEN next_kind <> 'focus_gained' AND (next_ts - ts_ms) % 30000 >= 3000
                THEN (next_ts - ts_ms) % 30000 ELSE 0 END AS duration,
         next_kind AS end_kind
  FROM te_m WHERE state IS NOT NULL AND next_ts IS NOT NULL)
"""


@register("tab_sessions", with_prelude("SELECT * FROM tab_sessions", _TAB_CTES))
def q_tab_sessions(spark, d):
    return cp.tab_sessions(fx.tab_events(spark, d))


@register("session_chunks", with_prelude("""
SELECT event_id * 1048576 + j AS id, user_id, url, title, start_ts + 30000 * j AS timestamp,
       least(30000, elapsed_ms - 30000 * j) AS duration
FROM (SELECT *, unnest(generate_series(0, elapsed_ms // 30000 +
        CASE WHEN end_kind <> 'focus_gained' AND elapsed_ms % 30000 >= 3000 THEN 1 ELSE 0 END - 1))
        AS j
      FROM tab_sessions)
WHERE least(30000, elapsed_ms - 30000 * j) >= 3000""", _TAB_CTES))
def q_session_chunks(spark, d):
    return cp.session_chunks(cp.tab_sessions(fx.tab_events(spark, d)))


@register("current_session", with_prelude(f"""
SELECT user_id, url, title, tab_id, ts_ms AS start_ts, {NOW} - ts_ms AS elapsed_ms,
       {format_clock_sql(f'{NOW} - ts_ms')} AS elapsed_text
FROM te_m WHERE state IS NOT NULL AND next_ts IS NULL""", _TAB_CTES))
def q_current_session(spark, d):
    return cp.current_session(fx.tab_events(spark, d), NOW)


@register("idle_spells", with_prelude(f"""
SELECT user_id, prev_ts AS idle_start, ts_ms - prev_ts AS idle_ms, event_id AS resumed_by FROM (
  SELECT *, lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS prev_ts
  FROM tab_events) WHERE ts_ms - prev_ts > {IDLE_AFTER_MS}"""))
def q_idle_spells(spark, d):
    return cp.idle_spells(fx.tab_events(spark, d), IDLE_AFTER_MS)


@register("late_night_alerts", with_prelude("""
SELECT user_id, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS night,
       min(timestamp) AS alert_ts, count(*) AS late_sessions
FROM sessions_raw
WHERE hour(make_timestamp(timestamp * 1000)) >= 1 AND hour(make_timestamp(timestamp * 1000)) < 7
GROUP BY 1, 2"""))
def q_late_night_alerts(spark, d):
    return cp.late_night_alerts(fx.sessions(spark, d))


@register("break_alerts", with_prelude("""
SELECT user_id, date, alert_ts, (alert_ts - f) // 3600000 AS alert_no FROM (
  SELECT user_id, date, f, unnest(generate_series(f + 3600000, l, 3600000)) AS alert_ts FROM (
    SELECT user_id, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS date,
           min(timestamp) AS f, max(timestamp + duration) AS l
    FROM sessions_raw GROUP BY 1, 2) WHERE l >= f + 3600000)"""))
def q_break_alerts(spark, d):
    return cp.break_alerts(fx.sessions(spark, d))


# --------------------------------------------------------------------------- categorise
_TECH = cz.FALLBACK_TECH_WORDS
_SOCIAL = cz.FALLBACK_SOCIAL_HOSTS
_LEARN = cz.FALLBACK_LEARNING_TITLE_WORDS


def _any_contains(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _fallback_sql(url: str, title: str) -> str:
    u, t = f"lower(coalesce({url}, ''))", f"lower(coalesce({title}, ''))"
    tech = f"({_any_contains(u, _TECH)} OR {_any_contains(t, _TECH)})"
    social = _any_contains(u, _SOCIAL)
    yt = f"(contains({u}, 'youtube.com') OR contains({u}, 'youtu.be'))"
    learn = _any_contains(t, _LEARN)
    return (f"CASE WHEN {yt} AND {learn} THEN 'Learning' WHEN {yt} AND NOT {tech} THEN 'Relaxation' "
            f"WHEN {tech} THEN 'Research' WHEN {social} THEN 'Mindless Scroll' "
            f"ELSE 'Uncategorized' END")


_CAT_CTES = f"""
fb AS (SELECT url, title, {_fallback_sql('url', 'title')} AS name FROM (
         SELECT DISTINCT url, title FROM sessions WHERE category_id IS NULL)),
fbid AS (SELECT fb.url, fb.title, fb.name, c.id AS category_id FROM fb LEFT JOIN cats c ON c.name = fb.name),
categorized AS (
  SELECT s.id, s.user_id, s.url, s.title, s.duration, s.timestamp,
         coalesce(s.category_id, f.category_id) AS category_id
  FROM sessions s LEFT JOIN fbid f
    ON s.category_id IS NULL AND f.url = s.url AND f.title IS NOT DISTINCT FROM s.title)
"""


@register("categorize_sessions", with_prelude(
    "SELECT id AS session_id, category_id FROM categorized", _CAT_CTES))
def q_categorize_sessions(spark, d):
    x = cz.categorize(fx.sessions(spark, d), fx.categories(spark))
    return x.select(F.col("id").alias("session_id"), "category_id")


@register("categorize_fallback", with_prelude("SELECT * FROM fbid", _CAT_CTES))
def q_categorize_fallback(spark, d):
    s = fx.categorized_sessions(spark, d)
    return cz.fallback_names(s, fx.categories(spark))


@register("categorize_pages", with_prelude(f"""
SELECT p.page_id, coalesce(r.id, f.id) AS category_id
FROM pages p LEFT JOIN cats r ON r.name = ({rule_case('p.url')})
LEFT JOIN cats f ON r.id IS NULL AND f.name = ({_fallback_sql('p.url', "''")})"""))
def q_categorize_pages(spark, d):
    """Rules and fallback over the varied URLs of the raw pages."""
    p = fx.pages(spark, d).select("page_id", "url", F.lit(None).cast("string").alias("title"),
                                  F.lit(None).cast("long").alias("category_id"))
    return cz.categorize(p, fx.categories(spark)).select("page_id", "category_id")


_BACKFILL_CTES = f"""
backlog AS (SELECT * FROM sessions_raw),
bl_rule AS (SELECT b.*, c.id AS rid FROM backlog b LEFT JOIN cats c ON c.name = ({rule_case('b.url')})),
bl_fb AS (SELECT url, title, {_fallback_sql('url', 'title')} AS name FROM (
            SELECT DISTINCT url, title FROM bl_rule WHERE rid IS NULL)),
backfill AS (
  SELECT r.id, r.user_id, r.url, r.title, r.duration, r.timestamp,
         coalesce(r.rid, c.id) AS new_category_id, coalesce(r.rid, c.id) IS NOT NULL AS updated
  FROM bl_rule r LEFT JOIN bl_fb f ON r.rid IS NULL AND f.url = r.url
       AND f.title IS NOT DISTINCT FROM r.title
  LEFT JOIN cats c ON c.name = f.name)
"""


@register("categorize_backfill", with_prelude("SELECT * FROM backfill", _BACKFILL_CTES))
def q_categorize_backfill(spark, d):
    return cz.categorize_backfill(fx.sessions(spark, d), fx.categories(spark))


@register("categorize_summary", with_prelude("""
SELECT user_id, count(*) FILTER (WHERE updated) AS categorized, count(*) AS total
FROM backfill GROUP BY 1""", _BACKFILL_CTES))
def q_categorize_summary(spark, d):
    return cz.categorize_summary(cz.categorize_backfill(fx.sessions(spark, d), fx.categories(spark)))


__all__ = ["rule_case"]
