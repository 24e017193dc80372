"""Query of operator 10."""

from __future__ import annotations

from tabtrail.llm import quality as q
from tabtrail.llm.common import table


def op10_quality_rules(spark, sf_dir):
    return q.assess(table(spark, sf_dir, "documents"))


QUERIES = {"op10_quality_rules": op10_quality_rules}

#: Counts restated over exploded windows; the own rules as one conjunction.
OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS p FROM d WHERE len(w) > 2)),
rep AS (SELECT r, p FROM win JOIN (SELECT r, s FROM win GROUP BY 1, 2 HAVING count(*) > 1) USING (r, s)),
cov AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY 1),
m AS (
  SELECT doc_id, t, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 10 * n_words
       AND 100 * len(regexp_extract_all(t, '\p{Lu}{2,}')) <= 30 * n_words
       AND 100 * len(regexp_extract_all(t, '!')) <= 25 * n_words
       AND 100 * n_dup_lines <= 50 * len(l)
       AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AS kept
FROM b
"""

ORACLES = {"op10_quality_rules": OP10_SQL}
