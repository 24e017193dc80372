"""Queries of the text-matching operators (7, 9)."""

from __future__ import annotations

from tabtrail.llm import decontaminate as dc, simhash as sh
from tabtrail.llm.common import table


def op7_decontaminate(spark, sf_dir):
    hits = dc.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return dc.digest(hits)


def op9_simhash(spark, sf_dir):
    marked = sh.near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", sh.hex_digits(marked.fp).alias("fingerprint"), "component_id")


QUERIES = {"op7_decontaminate": op7_decontaminate, "op9_simhash": op9_simhash}

# Words, windows and hits of operator 7 restated over (document, position) rows.
OP7_SQL = r"""
WITH w AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS s
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS p
        FROM w WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, dw.n, p FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLES = {"op7_decontaminate": OP7_SQL}
