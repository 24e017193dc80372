"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabtrail.llm import periodic
from tabtrail.llm.common import let, table

SPACE = "[\\x20\\x09-\\x0D]+"


def planted(doc_id: Column, text: Column) -> Column:
    """The text as the query reads it: where the id's checksum ends in 0, the words from the a-th on
    repeat with period p. A null id has no checksum and plants nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        again = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), again), " "))

    return F.when(h % 10 == 0, let(F.filter(F.split(text, SPACE), lambda w: w != ""), tail)).otherwise(text)


def digest(marked: DataFrame) -> DataFrame:
    better = lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (marked.withColumn("top", F.aggregate("runs", F.get("runs", F.lit(0)), better))
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period",
                    F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
                    F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return digest(periodic.mark_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}

#: Equal words a period apart as pairs; islands of consecutive pairs are the runs.
OP11_SQL = r"""
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t
        FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 255)) AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT r, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
c AS (SELECT r, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS h FROM b, tab),
e AS (SELECT r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n, h, h // 10 AS g FROM d LEFT JOIN c USING (r)),
f AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
        CASE WHEN i < g % n THEN ws[i + 1] ELSE ws[g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) + 1] END) ELSE ws END AS ws FROM e),
w AS (SELECT r, n, unnest(range(n)) AS i, unnest(ws) AS w FROM f),
m AS (SELECT v.r, v.i - u.i AS p, v.i FROM w v JOIN w u ON u.r = v.r AND u.w = v.w AND u.i < v.i AND 3 * (v.i - u.i) <= v.n),
k AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS isle FROM m),
l AS (SELECT r, p, min(i) - p AS start, count(*) + p AS length FROM k GROUP BY r, p, isle HAVING count(*) + p >= greatest(24, 3 * p)),
runs AS (SELECT r, start, length, min(p) AS period FROM l GROUP BY 1, 2, 3),
agg AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY 1),
top AS (SELECT r, start, length, period FROM (
  SELECT x.*, row_number() OVER (PARTITION BY x.r ORDER BY CAST(length AS HUGEINT) * y.lcm // period DESC, start, period) AS o
  FROM runs x JOIN (SELECT r, list_reduce(list_prepend(CAST(1 AS HUGEINT), list(DISTINCT CAST(period AS HUGEINT))), lambda a, z: lcm(a, z)) AS lcm FROM runs GROUP BY 1) y USING (r)) WHERE o = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.r, string_agg(w.w, ' ' ORDER BY w.i) AS s FROM w ANTI JOIN gone ON gone.r = w.r AND gone.i = w.i GROUP BY 1)
SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(agg.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM f LEFT JOIN agg USING (r) LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""

ORACLES = {"op11_periodic_runs": OP11_SQL}
