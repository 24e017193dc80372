"""Registered retrieval, reflection, dimension-change and upsert queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabtrail.constants import DAY_MS, NO_ACTIVITY_INSIGHT
from tabtrail.functions.urls import domain
from tabtrail.operators import dimension as dm
from tabtrail.operators import merge as mg
from tabtrail.operators import retrieval as rt
from tabtrail.operators import stats as st
from tabtrail.operators import vector_index as vi
from tabtrail.plans.oracle import (
    NOW,
    T0,
    domain_sql,
    format_hm_sql,
    iso_sql,
    with_prelude,
)
from tabtrail.plans.queries_stats import _LABEL_SQL, _SCORE_SQL, times_ctes
from tabtrail.plans.registry import register
from tabtrail.sources import fixtures as fx
from tabtrail.sources import sinks
from tabtrail.sources.tables import read_table

WEEK_START = NOW - 7 * DAY_MS
MONTH_START = NOW - 30 * DAY_MS
CACHE_CUTOFF = T0
FIRST_DAY, LAST_DAY = "2024-01-01", "2024-01-30"

_MIN = "CAST(floor({x} / 60000.0 + 0.5) AS BIGINT)"

# --------------------------------------------------------------------------- text, vectors
_VEC_CTES = """
vecs AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS id, e.embedding AS vals, s.user_id,
         coalesce(nullif(s.title, ''), 'Untitled session') AS title, s.url,
         nullif(s.timestamp, 0) AS timestamp, coalesce(s.duration, 0) AS duration,
         coalesce(nullif(s.cname, ''), 'Uncategorized') AS category, 'browser_session' AS source
  FROM embeddings e LEFT JOIN sj s ON s.id = e.vec_id),
qv AS (SELECT vec_id AS question_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
uqv AS (SELECT u.user_id AS question_id, e.embedding AS q
        FROM (SELECT DISTINCT user_id FROM sessions_raw) u JOIN embeddings e ON e.vec_id = u.user_id),
scored AS (
  SELECT v.*, qv.question_id, list_dot_product(v.vals::DOUBLE[], qv.q::DOUBLE[])
           / (sqrt(list_dot_product(v.vals::DOUBLE[], v.vals::DOUBLE[]))
              * sqrt(list_dot_product(qv.q::DOUBLE[], qv.q::DOUBLE[]))) AS score
  FROM vecs v, qv),
uscored AS (
  SELECT v.*, list_dot_product(v.vals::DOUBLE[], qv.q::DOUBLE[])
           / (sqrt(list_dot_product(v.vals::DOUBLE[], v.vals::DOUBLE[]))
              * sqrt(list_dot_product(qv.q::DOUBLE[], qv.q::DOUBLE[]))) AS score
  FROM vecs v JOIN uqv qv ON qv.question_id = v.user_id)
"""


@register("session_text", with_prelude(f"""
SELECT id, concat_ws(chr(10), 'Browsing session',
  CASE WHEN title IS NOT NULL AND title <> '' THEN 'Title: ' || title END,
  CASE WHEN url IS NOT NULL AND url <> '' THEN 'URL: ' || url END,
  'DurationMinutes: ' || CAST({_MIN.format(x='coalesce(duration, 0)')} AS VARCHAR),
  'Category: ' || cname,
  CASE WHEN timestamp IS NOT NULL AND timestamp <> 0 THEN 'Timestamp: ' || {iso_sql('timestamp')} END)
  AS text
FROM sj"""))
def q_session_text(spark, d):
    s = st.with_category(fx.categorized_sessions(spark, d), fx.categories(spark), ("name",))
    return s.select("id", rt.session_text(F.col("title"), F.col("url"), F.col("duration"),
                                          F.col("category_name"), F.col("timestamp")).alias("text"))


@register("vector_metadata", with_prelude("""
SELECT id, user_id, title, url, timestamp, duration, category, source FROM vecs""", _VEC_CTES))
def q_vector_metadata(spark, d):
    v = fx.session_vectors(spark, d)
    m = F.col("metadata")
    return v.select("id", *[m[f].alias(f) for f in
                            ("user_id", "title", "url", "timestamp", "duration", "category",
                             "source")])


_SIMILAR_SQL = with_prelude(f"""
SELECT question_id, rank, id, round(score, 6) AS score, title, url, timestamp,
       duration, category FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, id) AS rank
  FROM scored WHERE timestamp >= {MONTH_START}) WHERE rank <= 8""", _VEC_CTES)


@register("similar_sessions", _SIMILAR_SQL)
def q_similar_sessions(spark, d):
    m = rt.similar_sessions(fx.session_vectors(spark, d), fx.question_vectors(spark, d), 8, MONTH_START)
    return m.withColumn("score", F.round("score", 6))


def _by_index(spark, d, exact):
    m = vi.search_by_index(fx.session_vectors(spark, d), fx.question_vectors(spark, d),
                           sinks.scratch_table(spark, "vector-index"), 8, MONTH_START, exact)
    return m.withColumn("score", F.round("score", 6))


@register("similar_sessions_index")
def q_similar_sessions_index(spark, d):
    """K3 through the index, the calibrated number of lists a question (recall in the tests)."""
    return _by_index(spark, d, False)


@register("similar_sessions_index_exact", _SIMILAR_SQL)
def q_similar_sessions_index_exact(spark, d):
    """K3 through the index, then the lists that could still hold a better match."""
    return _by_index(spark, d, True)


_CLEAN_S = """
s2a AS (SELECT *, lag(timestamp + duration) OVER (PARTITION BY user_id, url ORDER BY timestamp, id)
          AS prev_end FROM sessions_raw),
s2b AS (SELECT *, sum(CASE WHEN prev_end IS NULL OR timestamp - prev_end > 120000 THEN 1 ELSE 0 END)
          OVER (PARTITION BY user_id, url ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS g
        FROM s2a),
kept AS (SELECT first(id ORDER BY timestamp, id) AS id FROM s2b GROUP BY user_id, url, g)
"""


@register("vector_orphans", with_prelude("""
SELECT 'orphan_vector' AS kind, CAST(vec_id AS VARCHAR) AS id FROM embeddings
WHERE vec_id NOT IN (SELECT id FROM kept)
UNION ALL
SELECT 'missing_vector' AS kind, CAST(id AS VARCHAR) AS id FROM kept
WHERE id NOT IN (SELECT vec_id FROM embeddings)""", _CLEAN_S))
def q_vector_orphans(spark, d):
    kept = mg.cleanup_duplicates(fx.sessions(spark, d))
    vectors = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return rt.vector_orphans(vectors, kept)


# --------------------------------------------------------------------------- reflection
def _ctx_ctes(start: int, name: str) -> str:
    site = ("'    • ' || coalesce(nullif(title, ''), url) || ' (' || "
            f"CAST({_MIN.format(x='duration')} AS VARCHAR) || 'm)' || chr(10)")
    return f"""
{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS recency
  FROM sj WHERE timestamp >= {start}),
{name}_r3 AS (SELECT *, row_number() OVER (PARTITION BY user_id, cname ORDER BY recency) AS site_rank
  FROM {name}_r),
{name} AS (
  SELECT user_id, cname AS category, count(*) AS session_count,
         CAST(sum(duration) AS BIGINT) AS total_time,
         {_MIN.format(x='sum(duration)')} AS minutes,
         row_number() OVER (PARTITION BY user_id ORDER BY min(recency)) AS first_pos,
         coalesce(string_agg(CASE WHEN site_rank <= 5 THEN {site} END, '' ORDER BY site_rank), '')
           AS sites_text
  FROM {name}_r3 GROUP BY 1, 2),
{name}_blocks AS (
  SELECT user_id, CAST(sum(session_count) AS BIGINT) AS total_sessions,
         string_agg('- ' || category || ': ' || CAST(minutes AS VARCHAR) || ' minutes (' ||
                    CAST(session_count AS VARCHAR) || ' sessions)' || chr(10) ||
                    CASE WHEN sites_text <> '' THEN '  Top sites:' || chr(10) || sites_text ELSE '' END,
                    '' ORDER BY first_pos) AS b
  FROM {name} GROUP BY 1)
"""


_NO_ACT = "'No browsing activity found for this time period.'"
_CTX_HEAD = "'Total sessions: ' || CAST(b.total_sessions AS VARCHAR) || chr(10) || chr(10) || " \
            "'Time by category:' || chr(10) || b.b"


@register("reflection_context_stats", with_prelude("SELECT * FROM wk", _ctx_ctes(WEEK_START, "wk")))
def q_reflection_context_stats(spark, d):
    rows = rt.context_rows(fx.categorized_sessions(spark, d, WEEK_START), fx.categories(spark), WEEK_START)
    return rt.context_stats(rows)


@register("weekly_context", with_prelude(f"""
SELECT u.user_id, coalesce(b.total_sessions, 0) AS total_sessions,
       CASE WHEN b.total_sessions IS NULL THEN {_NO_ACT} ELSE {_CTX_HEAD} END AS context
FROM (SELECT DISTINCT user_id FROM sessions_raw) u LEFT JOIN wk_blocks b ON b.user_id = u.user_id""",
    _ctx_ctes(WEEK_START, "wk")))
def q_weekly_context(spark, d):
    return _weekly(spark, d)


def _weekly(spark, d):
    s = fx.categorized_sessions(spark, d, WEEK_START)
    stats = rt.context_stats(rt.context_rows(s, fx.categories(spark), WEEK_START))
    return rt.reflection_context(fx.sessions(spark, d), stats)


_REL = (f"'- ' || CAST(rank AS VARCHAR) || '. ' || coalesce(nullif(title, ''), url) || ' (' || "
        f"CAST({_MIN.format(x='coalesce(duration, 0)')} AS VARCHAR) || 'm, ' || "
        f"CASE WHEN timestamp IS NOT NULL AND timestamp <> 0 THEN {iso_sql('timestamp')} "
        f"ELSE 'Unknown time' END || ')' || chr(10) || '  ' || url || chr(10)")


@register("reflection_context", with_prelude(f"""
SELECT u.user_id, coalesce(b.total_sessions, 0) AS total_sessions,
       CASE WHEN b.total_sessions IS NULL THEN {_NO_ACT}
            ELSE {_CTX_HEAD} || CASE WHEN r.rel IS NOT NULL
                 THEN chr(10) || 'Relevant sessions for user query:' || chr(10) || r.rel ELSE '' END
       END AS context
FROM (SELECT DISTINCT user_id FROM sessions_raw) u
LEFT JOIN mo_blocks b ON b.user_id = u.user_id
LEFT JOIN (SELECT user_id, string_agg({_REL}, '' ORDER BY rank) AS rel FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS rank
    FROM uscored WHERE timestamp >= {MONTH_START}) WHERE rank <= 8 GROUP BY 1) r
  ON r.user_id = u.user_id""", _ctx_ctes(MONTH_START, "mo") + "," + _VEC_CTES))
def q_reflection_context(spark, d):
    s = fx.categorized_sessions(spark, d, MONTH_START)
    stats = rt.context_stats(rt.context_rows(s, fx.categories(spark), MONTH_START))
    m = rt.similar_sessions(fx.session_vectors(spark, d), fx.user_question_vectors(spark, d), 8,
                            MONTH_START, per_user=True)
    return rt.reflection_context(fx.sessions(spark, d), stats, m)


@register("reflection_history", with_prelude("""
SELECT id, user_id, query, response, timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS rn
  FROM refl) WHERE rn <= 20""", f"""
refl AS (
  SELECT conv_id * 1000 + turn AS id, conv_id % 15 AS user_id, text AS query, next_text AS response,
         {fx.EPOCH_2024_MS} + (conv_id * 1000 + turn) * 1000 AS timestamp
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""))
def q_reflection_history(spark, d):
    return rt.reflection_history(fx.reflections(spark, d))


_REFL_CTES = f"""
refl AS (
  SELECT conv_id * 1000 + turn AS id, conv_id % 15 AS user_id, text AS query, next_text AS response,
         {fx.EPOCH_2024_MS} + (conv_id * 1000 + turn) * 1000 AS timestamp
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""
SHOWN_REFLECTION = 3000


@register("reflection_by_id", with_prelude(
    f"SELECT id, user_id, query, response, timestamp FROM refl WHERE id = {SHOWN_REFLECTION}", _REFL_CTES))
def q_reflection_by_id(spark, d):
    return rt.reflection_by_id(fx.reflections(spark, d), SHOWN_REFLECTION).select(
        "id", "user_id", "query", "response", "timestamp")


@register("reflection_log", with_prelude(f"""
SELECT r.id, r.user_id, r.query, r.timestamp,
       CASE WHEN u.user_id IS NULL THEN NULL WHEN b.total_sessions IS NULL THEN {_NO_ACT} ELSE {_CTX_HEAD} END AS response,
       CASE WHEN u.user_id IS NOT NULL THEN coalesce(b.total_sessions, 0) END AS total_sessions
FROM refl r LEFT JOIN (SELECT DISTINCT user_id FROM sessions_raw) u ON u.user_id = r.user_id
LEFT JOIN wk_blocks b ON b.user_id = u.user_id""", _REFL_CTES + "," + _ctx_ctes(WEEK_START, "wk")))
def q_reflection_log(spark, d):
    """Reflections appended to a log with their context as JSON, read back, decoded."""
    path = sinks.scratch_table(spark, "reflections")
    sinks.append(sinks.reflection_records(fx.reflections(spark, d), _weekly(spark, d)), path)
    log = spark.read.parquet(path)
    return log.select("id", "user_id", "query", "timestamp", "response",
                      rt.parse_context(F.col("context"))["total_sessions"].alias("total_sessions"))


_PLAN_SQL = f"""
SELECT u.user_id, strftime(d.dd, '%Y-%m-%d') AS date,
       CASE WHEN c.user_id IS NOT NULL THEN 'cached' WHEN m.session_count IS NULL THEN 'no_activity'
            ELSE 'generate' END AS action,
       CASE WHEN m.total_time IS NOT NULL THEN {format_hm_sql('m.total_time')} END AS total_text,
       m.session_count, m.top_category
FROM (SELECT DISTINCT user_id FROM sessions_raw) u
CROSS JOIN (SELECT unnest(generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY)) AS dd) d
LEFT JOIN (
  SELECT user_id, date, CAST(sum(t) AS BIGINT) AS total_time, CAST(sum(n) AS BIGINT) AS session_count,
         first(cname ORDER BY t DESC, cname) AS top_category
  FROM (SELECT user_id, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS date, cname,
               sum(duration) AS t, count(*) AS n FROM sj GROUP BY 1, 2, 3) GROUP BY 1, 2) m
  ON m.user_id = u.user_id AND m.date = strftime(d.dd, '%Y-%m-%d')
LEFT JOIN (SELECT DISTINCT user_id, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS date
           FROM sessions_raw WHERE timestamp < {CACHE_CUTOFF}) c
  ON c.user_id = u.user_id AND c.date = strftime(d.dd, '%Y-%m-%d')"""


def _insight_plan(spark, d):
    from tabtrail.functions.time import day_string
    s = fx.categorized_sessions(spark, d)
    cache = s.filter(F.col("timestamp") < CACHE_CUTOFF).select(
        "user_id", day_string(F.col("timestamp")).alias("date")).distinct()
    return rt.insight_cache_plan(s, fx.categories(spark), cache, FIRST_DAY, LAST_DAY)


@register("insight_cache_plan", with_prelude(_PLAN_SQL))
def q_insight_cache_plan(spark, d):
    return _insight_plan(spark, d)


@register("insight_rows", with_prelude(f"""
SELECT user_id, date,
       CASE WHEN action = 'no_activity' THEN '{NO_ACTIVITY_INSIGHT.replace("'", "''")}'
            ELSE 'Top category: ' || coalesce(top_category, '-') END AS insight_text,
       total_text, session_count, top_category, {NOW} AS generated_ms
FROM ({_PLAN_SQL}) WHERE action <> 'cached'"""))
def q_insight_rows(spark, d):
    """Daily insights upserted into a table by user and date (twice, to the same result)."""
    path = sinks.scratch_table(spark, "insights")
    rows = sinks.insight_records(_insight_plan(spark, d), NOW)
    sinks.write_upsert(rows, path, ["user_id", "date"], partition_by=["date"])
    m = F.col("metadata")
    return sinks.write_upsert(rows, path, ["user_id", "date"], partition_by=["date"]).select(
        "user_id", "date", "insight_text", m["totalTime"].alias("total_text"),
        m["sessionCount"].alias("session_count"), m["topCategory"].alias("top_category"),
        F.unix_millis("generated_at").alias("generated_ms"))


@register("ingest_append", with_prelude(f"""
SELECT id, user_id, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS date FROM (
  SELECT id, user_id, CASE WHEN id % 17 = 0 THEN NULL ELSE url END AS url,
         CASE WHEN id % 23 = 0 THEN 0 ELSE duration END AS duration,
         CASE WHEN id % 29 = 0 THEN NULL ELSE timestamp END AS timestamp FROM sessions_raw)
WHERE url <> '' AND duration <> 0 AND timestamp <> 0"""))
def q_ingest_append(spark, d):
    """The valid rows of an upload, appended by date and read back."""
    from tabtrail.functions.time import day_string
    path = sinks.scratch_table(spark, "sessions")
    valid, _ = dm.split_valid(fx.uploaded_sessions(spark, d))
    sinks.append(valid.select("id", "user_id", "url", "duration", "timestamp",
                              day_string(F.col("timestamp")).alias("date")), path, partition_by=["date"])
    return spark.read.parquet(path).select("id", "user_id", F.col("date").cast("string").alias("date"))


@register("vector_rebuild", with_prelude("""
SELECT CAST(id AS VARCHAR) AS id, coalesce(nullif(title, ''), 'Untitled session') AS title, cname AS category,
       'browser_session' AS source, 64 AS dims FROM sj"""))
def q_vector_rebuild(spark, d):
    """Every session embedded anew into a table, read back."""
    path = sinks.scratch_table(spark, "vectors")
    sinks.rebuild_vectors(fx.categorized_sessions(spark, d), fx.categories(spark), path)
    m = F.col("metadata")
    return spark.read.parquet(path).select("id", m["title"].alias("title"), m["category"].alias("category"),
                                           m["source"].alias("source"), F.size("values").alias("dims"))


@register("vector_upsert", with_prelude("""
SELECT id, category, title, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN duration + 2 ELSE duration END AS duration, 64 AS dims FROM vecs
UNION ALL
SELECT 'again-' || id, category, title, duration + 2, 64 FROM vecs WHERE CAST(id AS BIGINT) % 3 = 0""", _VEC_CTES))
def q_vector_upsert(spark, d):
    """Vectors upserted into a table by id: all of them, then a third of them twice, under their own and under
    new ids; the last of each id stays."""
    path = sinks.scratch_table(spark, "vector-table")
    v = fx.session_vectors(spark, d)
    sinks.write_upsert(v, path, ["id"])
    later = v.filter(F.col("id").cast("long") % 3 == 0).select(
        F.explode(F.array(F.col("id"), F.concat(F.lit("again-"), "id"))).alias("id"), "values", "metadata")
    later = later.select("id", "values", "metadata", F.explode(F.array(F.lit(2), F.lit(1))).alias("seq"))
    meta = F.col("metadata").withField("duration", F.col("metadata.duration") + F.col("seq"))
    now = sinks.write_upsert(later.withColumn("metadata", meta), path, ["id"], order_by=["seq"], columns=v.columns)
    m = F.col("metadata")
    return now.select("id", m["category"].alias("category"), m["title"].alias("title"), m["duration"].alias("duration"),
                      F.size("values").alias("dims"))


_TEXT_SQL = f"""
SELECT id, concat_ws(chr(10), 'Browsing session',
  CASE WHEN title IS NOT NULL AND title <> '' THEN 'Title: ' || title END,
  CASE WHEN url IS NOT NULL AND url <> '' THEN 'URL: ' || url END,
  'DurationMinutes: ' || CAST({_MIN.format(x='coalesce(duration, 0)')} AS VARCHAR),
  'Category: ' || cname,
  CASE WHEN timestamp IS NOT NULL AND timestamp <> 0 THEN 'Timestamp: ' || {iso_sql('timestamp')} END)
  AS text
FROM sj"""


@register("embed_sessions", with_prelude("""
SELECT id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 5) AS value FROM (
  SELECT id, place, CAST(count(*) AS DOUBLE) AS n FROM (
    SELECT CAST(id AS VARCHAR) AS id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS place
    FROM (SELECT id, unnest(string_split_regex(lower(text), '\\s')) AS word FROM texts) WHERE word <> '')
  GROUP BY 1, 2)""", f"texts AS ({_TEXT_SQL})"))
def q_embed_sessions(spark, d):
    from tabtrail.operators.embed import embed_sessions
    s = st.with_category(fx.categorized_sessions(spark, d), fx.categories(spark), ("name",))
    v = embed_sessions(s).select("id", F.posexplode_outer("values").alias("place", "value"))
    return v.filter(F.col("value") != 0).select(
        "id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 5).alias("value"))


# --------------------------------------------------------------------------- dimension
def _page_changes(spark, d):
    p = fx.pages(spark, d)
    url, pid = F.col("url"), F.col("page_id")
    dom = domain(url)
    op = (F.when(url.contains("?"), F.lit("create")).when(url.contains("#"), F.lit("update"))
          .when(url.endswith(".html"), F.lit("delete")))
    return p.select(
        pid.alias("seq"), op.alias("op"),
        F.when(op == "create", F.lit(1000) + pid).otherwise(pid % 10 + 1).alias("id"),
        F.when(op == "create", dom).when((op == "update") & (pid % 5 == 0), F.concat(
            F.lit("Renamed by "), pid.cast("string"))).alias("name"),
        F.when(op == "create", F.concat(F.lit("Pages on "), dom))
        .when(op == "update", F.concat(F.lit("Updated from page "), pid.cast("string")))
        .alias("description"),
        F.when(op == "create", F.lit("#607D8B"))
        .when(op == "update", F.concat(F.lit("#"), F.upper(F.substring(F.md5(url), 1, 6))))
        .alias("color"),
        F.when(op == "create", F.lit("unknown"))
        .when((op == "update") & (pid % 4 == 0), F.lit("rest")).alias("wellness_type"),
        ((op == "update") & (pid % 3 == 0)).alias("set_description"),
    ).filter(op.isNotNull())


_CHANGES_CTES = f"""
ch AS (
  SELECT page_id AS seq, op,
         CASE WHEN op = 'create' THEN 1000 + page_id ELSE page_id % 10 + 1 END AS id,
         CASE WHEN op = 'create' THEN dom
              WHEN op = 'update' AND page_id % 5 = 0 THEN 'Renamed by ' || CAST(page_id AS VARCHAR) END AS name,
         CASE WHEN op = 'create' THEN 'Pages on ' || dom
              WHEN op = 'update' THEN 'Updated from page ' || CAST(page_id AS VARCHAR) END AS description,
         CASE WHEN op = 'create' THEN '#607D8B'
              WHEN op = 'update' THEN '#' || upper(substr(md5(url), 1, 6)) END AS color,
         CASE WHEN op = 'create' THEN 'unknown' WHEN op = 'update' AND page_id % 4 = 0 THEN 'rest' END AS wellness_type,
         (op = 'update' AND page_id % 3 = 0) AS set_description
  FROM (SELECT *, {domain_sql('url')} AS dom,
               CASE WHEN contains(url, '?') THEN 'create' WHEN contains(url, '#') THEN 'update'
                    WHEN ends_with(url, '.html') THEN 'delete' END AS op FROM pages)
  WHERE op IS NOT NULL),
cr AS (SELECT ch.*, row_number() OVER (PARTITION BY ch.name ORDER BY ch.seq) AS nrank,
              c.name AS bn FROM ch LEFT JOIN cats c ON c.name = ch.name WHERE ch.op = 'create'),
created AS (SELECT id, name, description, color, wellness_type FROM cr
            WHERE bn IS NULL AND nrank = 1 AND name IS NOT NULL AND name <> ''),
after_create AS (SELECT id, name, description, color, wellness_type FROM cats
                 UNION ALL SELECT * FROM created),
up AS (SELECT ch.*, a.id AS eid FROM ch LEFT JOIN after_create a ON a.id = ch.id WHERE ch.op = 'update'),
upd AS (
  SELECT id,
    arg_max(color, seq) FILTER (WHERE color IS NOT NULL AND color <> '') AS u_color,
    bool_or(color IS NOT NULL AND color <> '') AS h_color,
    arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS u_name,
    arg_max(wellness_type, seq) FILTER (WHERE wellness_type IS NOT NULL) AS u_wtype,
    arg_max(description, seq) FILTER (WHERE set_description) AS u_description,
    bool_or(set_description) AS h_description
  FROM up WHERE eid IS NOT NULL GROUP BY 1),
after_update AS (
  SELECT a.id, coalesce(u.u_name, a.name) AS name,
         CASE WHEN u.h_description THEN u.u_description ELSE a.description END AS description,
         CASE WHEN u.h_color THEN u.u_color ELSE a.color END AS color,
         coalesce(u.u_wtype, a.wellness_type) AS wellness_type
  FROM after_create a LEFT JOIN upd u ON u.id = a.id),
de AS (SELECT ch.*, row_number() OVER (PARTITION BY ch.id ORDER BY ch.seq) AS drank, a.id AS did
       FROM ch LEFT JOIN after_update a ON a.id = ch.id WHERE ch.op = 'delete'),
final_cats AS (SELECT * FROM after_update WHERE id NOT IN (
                 SELECT id FROM de WHERE did IS NOT NULL AND drank = 1)),
rejected AS (
  SELECT seq, op, id, CASE WHEN name IS NOT NULL AND name <> '' THEN 'duplicate name'
                           ELSE 'name required' END AS reason
  FROM cr WHERE NOT (bn IS NULL AND nrank = 1 AND name IS NOT NULL AND name <> '')
  UNION ALL SELECT seq, op, id, 'not found' FROM up WHERE eid IS NULL
  UNION ALL SELECT seq, op, id, 'not found' FROM de WHERE did IS NULL OR drank > 1)
"""


def _apply_changes(spark, d):
    return dm.apply_category_changes(fx.categories(spark), _page_changes(spark, d))


@register("category_changes", with_prelude("SELECT * FROM final_cats", _CHANGES_CTES))
def q_category_changes(spark, d):
    return _apply_changes(spark, d)[0]


@register("category_changes_rejected", with_prelude("SELECT * FROM rejected", _CHANGES_CTES))
def q_category_changes_rejected(spark, d):
    return _apply_changes(spark, d)[1]


@register("category_delete_cascade", with_prelude("""
SELECT s.id, CASE WHEN s.category_id IN (SELECT id FROM cats WHERE id NOT IN (SELECT id FROM final_cats))
                  THEN NULL ELSE s.category_id END AS category_id
FROM sessions s""", _CHANGES_CTES))
def q_category_delete_cascade(spark, d):
    gone = dm.deleted_ids(_page_changes(spark, d))
    return dm.cascade_delete(fx.categorized_sessions(spark, d), gone).select("id", "category_id")


_SEED_CTES = f"""
existing AS (SELECT min(page_id) + 1000 AS id, dom AS name, 'Pages on ' || dom AS description,
                    '#607D8B' AS color, 'unknown' AS wellness_type
             FROM (SELECT page_id, {domain_sql('url')} AS dom FROM pages) GROUP BY dom)
"""


def _existing(spark, d):
    p = fx.pages(spark, d).select("page_id", domain(F.col("url")).alias("dom"))
    return p.groupBy("dom").agg((F.min("page_id") + 1000).alias("id")).select(
        "id", F.col("dom").alias("name"), F.concat(F.lit("Pages on "), F.col("dom")).alias("description"),
        F.lit("#607D8B").alias("color"), F.lit("unknown").alias("wellness_type"))


@register("category_seed", with_prelude("""
SELECT * FROM existing UNION ALL
SELECT id, name, description, color, wellness_type FROM cats
WHERE name NOT IN (SELECT name FROM existing)""", _SEED_CTES))
def q_category_seed(spark, d):
    return dm.seed_if_absent(_existing(spark, d), fx.categories(spark))


@register("categories_list", with_prelude("SELECT * FROM final_cats", _CHANGES_CTES))
def q_categories_list(spark, d):
    return dm.list_categories(_apply_changes(spark, d)[0])


def _overrides(spark, d):
    p = fx.pages(spark, d)
    return p.select(F.col("page_id").alias("seq"), (F.col("page_id") * 41).alias("session_id"),
                    (F.col("page_id") % 8 + 1).alias("category_id"))


_OVR_CTES = """
ovr AS (SELECT session_id, arg_max(category_id, seq) AS category_id FROM (
          SELECT page_id AS seq, page_id * 41 AS session_id, page_id % 8 + 1 AS category_id
          FROM pages) GROUP BY 1)
"""


@register("category_override", with_prelude("""
SELECT s.id, s.user_id, s.url, s.title, s.duration, s.timestamp,
       CASE WHEN o.session_id IS NOT NULL THEN o.category_id ELSE s.category_id END AS category_id,
       o.session_id IS NOT NULL AS overridden
FROM sessions s LEFT JOIN ovr o ON o.session_id = s.id""", _OVR_CTES))
def q_category_override(spark, d):
    return dm.apply_overrides(fx.categorized_sessions(spark, d), _overrides(spark, d))[0]


@register("category_override_missing", with_prelude("""
SELECT session_id, category_id FROM ovr WHERE session_id NOT IN (SELECT id FROM sessions)""",
    _OVR_CTES))
def q_category_override_missing(spark, d):
    return dm.apply_overrides(fx.categorized_sessions(spark, d), _overrides(spark, d))[1]


@register("ingest_validation", with_prelude("""
SELECT id, user_id, CASE WHEN m <> '' THEN 'rejected' ELSE 'valid' END AS status,
       CASE WHEN m <> '' THEN 'Missing required fields' END AS reason,
       CASE WHEN m <> '' THEN m END AS missing_fields
FROM (SELECT id, user_id, concat_ws(',',
        CASE WHEN url IS NULL OR url = '' THEN 'url' END,
        CASE WHEN duration IS NULL OR duration = 0 THEN 'duration' END,
        CASE WHEN timestamp IS NULL OR timestamp = 0 THEN 'timestamp' END) AS m
      FROM (SELECT id, user_id, CASE WHEN id % 17 = 0 THEN NULL ELSE url END AS url,
                   CASE WHEN id % 23 = 0 THEN 0 ELSE duration END AS duration,
                   CASE WHEN id % 29 = 0 THEN NULL ELSE timestamp END AS timestamp FROM sessions_raw))"""))
def q_ingest_validation(spark, d):
    return dm.validate_chunks(fx.uploaded_sessions(spark, d))


_UPSERT_DAY = "strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d')"
_UPSERT_FROM = T0 - 3 * DAY_MS


def _daily_sql(where: str, name: str) -> str:
    body = times_ctes(_UPSERT_DAY, where, name + "_")
    return body + f""",
{name} AS (SELECT user_id, date, score, {_LABEL_SQL} AS label, focus_time, learning_time,
           rest_time, social_time, mindless_time, total_time
           FROM (SELECT *, {_SCORE_SQL} AS score FROM {name}_t))"""


@register("wellness_daily_upsert", with_prelude("""
SELECT *, 'old' AS source FROM old_w o
WHERE NOT EXISTS (SELECT 1 FROM new_w n WHERE n.user_id = o.user_id AND n.date = o.date)
UNION ALL SELECT *, 'new' AS source FROM new_w""",
    _daily_sql(f"WHERE timestamp < {T0} AND duration > 60000", "old_w") + ","
    + _daily_sql(f"WHERE timestamp >= {_UPSERT_FROM}", "new_w")))
def q_wellness_daily_upsert(spark, d):
    c = fx.categories(spark)
    past = fx.categorized_sessions(spark, d, end=T0 - 1)
    old = st.wellness_daily(past.filter(F.col("duration") > 60000), c)
    new = st.wellness_daily(fx.categorized_sessions(spark, d, _UPSERT_FROM), c)
    return dm.upsert(old.withColumn("source", F.lit("old")), new.withColumn("source", F.lit("new")),
                     ["user_id", "date"])
