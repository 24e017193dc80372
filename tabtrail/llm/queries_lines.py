"""Query of operator 13."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabtrail.llm import line_dedup
from tabtrail.llm.common import table


def op13_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op13_line_dedup": op13_line_dedup}

#: Lines as rows, their documents counted, the kept ones joined again.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY 1 HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS s FROM l ANTI JOIN f USING (k) GROUP BY 1)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

ORACLES = {"op13_line_dedup": OP13_SQL}
