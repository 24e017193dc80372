"""DuckDB oracle SQL for the registered queries.

Each statement starts from the driver's raw tables (``events``, ``embeddings``,
``pages``, ``conversations``) and re-derives the fixture tables in SQL (``PRELUDE``),
so the oracle shares only input data with the Spark code: the site catalog rows, the
category seed rows and the URL rule list. The rule with a lookahead is rewritten for
RE2 as "contains github.com and not github.com.*/(pull|issues)".
"""

from __future__ import annotations

from tabtrail.constants import CATEGORY_SEED, URL_RULES, WELLNESS_TYPE_BY_NAME
from tabtrail.sources.catalog import SITES
from tabtrail.sources.fixtures import (
    EPOCH_2024_MS,
    EVENT_KIND,
    FIXED_NOW_MS,
    TAB_TIME_COMPRESSION,
    TODAY_END_MS,
    TODAY_START_MS,
)

LOOKAHEAD = r"github\.com(?!.*\/(pull|issues))"


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def rule_case(col: str = "url") -> str:
    parts = []
    for name, pats in URL_RULES:
        plain = [p for p in pats if p != LOOKAHEAD]
        cond = f"regexp_matches({col}, {q('(?:' + '|'.join(plain) + ')')}, 'i')"
        if LOOKAHEAD in pats:
            cond = (f"({cond} OR (regexp_matches({col}, 'github\\.com', 'i') AND NOT "
                    f"regexp_matches({col}, 'github\\.com.*/(pull|issues)', 'i')))")
        parts.append(f"WHEN {cond} THEN {q(name)}")
    return "CASE " + " ".join(parts) + " END"


def wellness_case(col: str) -> str:
    return ("CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}"
                               for k, v in WELLNESS_TYPE_BY_NAME.items())
            + " ELSE 'unknown' END")


def internal_cond(col: str = "url") -> str:
    return (f"(starts_with({col}, 'chrome://') OR starts_with({col}, 'chrome-extension://') "
            f"OR contains({col}, 'localhost') OR contains({col}, '127.0.0.1'))")


_URL_RE = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)'"


def url_parts_sql(col: str) -> dict:
    scheme = f"lower(regexp_extract({col}, {_URL_RE}, 1))"
    hp = f"regexp_replace(regexp_extract({col}, {_URL_RE}, 2), '^.*@', '')"
    host = f"lower(regexp_replace({hp}, ':[0-9]*$', ''))"
    port = f"regexp_extract({hp}, ':([0-9]*)$', 1)"
    path = f"regexp_extract({col}, {_URL_RE}, 3)"
    return dict(scheme=scheme, host=host, port=port, path=path)


def normalize_sql(col: str) -> str:
    p = url_parts_sql(col)
    keep = (f"({p['port']} <> '' AND NOT ({p['scheme']} = 'http' AND {p['port']} = '80') "
            f"AND NOT ({p['scheme']} = 'https' AND {p['port']} = '443'))")
    norm = (f"{p['scheme']} || '://' || {p['host']} || "
            f"(CASE WHEN {keep} THEN ':' || {p['port']} ELSE '' END) || "
            f"(CASE WHEN {p['path']} = '' THEN '/' ELSE {p['path']} END)")
    return f"(CASE WHEN {p['scheme']} = '' THEN {col} ELSE {norm} END)"


def domain_sql(col: str) -> str:
    p = url_parts_sql(col)
    return f"(CASE WHEN {p['scheme']} = '' THEN {col} ELSE {p['host']} END)"


def format_hm_sql(ms: str) -> str:
    m = f"(({ms}) // 60000)"
    h = f"({m} // 60)"
    return (f"(CASE WHEN {h} > 0 THEN CAST({h} AS VARCHAR) || 'h ' || CAST({m} % 60 AS VARCHAR)"
            f" || 'm' ELSE CAST({m} AS VARCHAR) || 'm' END)")


def format_hms_sql(ms: str) -> str:
    m = f"(({ms}) // 60000)"
    s = f"((({ms}) % 60000) // 1000)"
    h = f"({m} // 60)"
    return (f"(CASE WHEN {h} > 0 THEN CAST({h} AS VARCHAR) || 'h ' || CAST({m} % 60 AS VARCHAR)"
            f" || 'm' WHEN {m} > 0 THEN CAST({m} AS VARCHAR) || 'm ' || CAST({s} AS VARCHAR)"
            f" || 's' ELSE CAST({s} AS VARCHAR) || 's' END)")


def format_clock_sql(ms: str) -> str:
    t = f"(({ms}) // 1000)"
    h = f"({t} // 3600)"
    m = f"(({t} % 3600) // 60)"
    s = f"({t} % 60)"
    return (f"(CASE WHEN {h} > 0 THEN CAST({h} AS VARCHAR) || ':' || lpad(CAST({m} AS VARCHAR), 2, '0')"
            f" || ':' || lpad(CAST({s} AS VARCHAR), 2, '0') ELSE CAST({m} AS VARCHAR) || ':' || "
            f"lpad(CAST({s} AS VARCHAR), 2, '0') END)")


def fixed_sql(num: str, den: str, digits: int, scale: int = 1) -> str:
    p = 10 ** digits
    units = f"((({num}) * {2 * p * scale} + ({den})) // (2 * ({den})))"
    return (f"(CAST({units} // {p} AS VARCHAR) || '.' || "
            f"lpad(CAST({units} % {p} AS VARCHAR), {digits}, '0'))")


def js_round_sql(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def day_sql(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%d')"


def iso_sql(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


_sites = ", ".join(f"({i}, {q(u)}, {q(t)})" for i, (u, t) in enumerate(SITES))
_cats = ", ".join(f"({i}, {q(n)}, {q(d)}, {q(c)}, {q(w)})" for i, n, d, c, w in CATEGORY_SEED)
_kinds = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in EVENT_KIND.items())

PRELUDE = f"""
sites(site_id, url, title) AS (VALUES {_sites}),
cats AS (SELECT CAST(id AS BIGINT) AS id, name, description, color, wellness_type
         FROM (VALUES {_cats}) v(id, name, description, color, wellness_type)),
ev AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ts_ms,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 40 AS site_id, value
  FROM events),
sessions_raw AS (
  SELECT e.event_id AS id, e.user_id, st.url, st.title,
         CAST(round(e.value * 100) AS BIGINT) * 100 AS duration, e.ts_ms AS timestamp,
         CAST(NULL AS BIGINT) AS category_id
  FROM ev e LEFT JOIN sites st ON st.site_id = e.site_id),
sessions AS (
  SELECT s.id, s.user_id, s.url, s.title, s.duration, s.timestamp, c.id AS category_id
  FROM sessions_raw s LEFT JOIN cats c ON c.name = ({rule_case('s.url')})),
sj AS (
  SELECT s.*, coalesce(nullif(c.name, ''), 'Uncategorized') AS cname,
         coalesce(nullif(c.color, ''), '#9E9E9E') AS ccolor,
         coalesce(nullif(c.wellness_type, ''), 'unknown') AS cwtype
  FROM sessions s LEFT JOIN cats c ON c.id = s.category_id),
chunk_base AS (
  SELECT id, user_id, url, title, timestamp, duration,
         unnest(generate_series(0, greatest((duration + 29999) // 30000 - 1, 0))) AS i
  FROM sessions_raw),
chunk_all AS (
  SELECT id * 1048576 + i AS id, user_id, url, title, i,
         timestamp + 30000 * i + 36000 * (i // 7) + 130000 * (i // 20) AS timestamp,
         least(30000, duration - 30000 * i) AS duration
  FROM chunk_base),
chunks AS (SELECT id, user_id, url, title, timestamp, duration FROM chunk_all WHERE duration >= 3000),
chunks_v AS (
  SELECT id, user_id,
         CASE WHEN i % 2 = 1 THEN url || '#s' || CAST(i AS VARCHAR) ELSE url END AS url,
         title, timestamp, duration
  FROM chunk_all WHERE duration >= 3000),
tab_events AS (
  SELECT e.event_id, e.user_id,
         {EPOCH_2024_MS} + (e.ts_ms - {EPOCH_2024_MS}) // {TAB_TIME_COMPRESSION} AS ts_ms,
         CASE e.event_type {_kinds} END AS kind, e.event_id % 5 AS tab_id, st.url, st.title
  FROM ev e LEFT JOIN sites st ON st.site_id = e.site_id)
"""

NOW = FIXED_NOW_MS
T0, T1 = TODAY_START_MS, TODAY_END_MS


def with_prelude(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    ctes = PRELUDE + ("," + extra_ctes if extra_ctes else "")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + "\n" + body
