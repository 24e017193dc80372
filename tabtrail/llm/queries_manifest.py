"""Query of operator 12."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from tabtrail.llm import merkle
from tabtrail.llm.common import table


def leaf(doc: list[Column], text: Column) -> Column:
    return merkle.digest(*(merkle.field(c) for c in [*doc, text]))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of the documents; those whose id's checksum 5 divides also have the leaf of the lower-cased text.
    The others climb with the leaf itself."""
    doc = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(F.col("source").cast("string").alias("grp"), F.col("doc_id").cast("bigint").alias("key"),
                       leaf(doc, F.col("text")).alias("leaf"), F.when(chosen, leaf(doc, low)).alias("changed"))


def op12_merkle_manifest(spark, sf_dir):
    proofs = merkle.prove(merkle.build(document_leaves(table(spark, sf_dir, "documents"))))
    return proofs.withColumnRenamed("key", "doc_id")


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}

#: Each tree as a recursion over whole lists of hashes; each proof and fold as a recursion over the levels.
OP12_SQL = r"""
WITH RECURSIVE
tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t
        FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 255)) AS i)),
d AS (SELECT row_number() OVER () AS r, *, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
        || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
        || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
b AS (SELECT r, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
c AS (SELECT r, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS h FROM b, tab),
e AS (SELECT r, doc_id, coalesce('+' || source, '-') AS grp,
             sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
             CASE WHEN h % 5 = 0 THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS changed
      FROM d LEFT JOIN c USING (r)),
f AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM e),
own(grp, lvl, l) AS (
  SELECT grp, 0, list(leaf ORDER BY i) FROM f GROUP BY 1
  UNION ALL
  SELECT grp, lvl + 1, list_transform(range(CAST(ceil(len(l) / 16.0) AS BIGINT)), lambda k: sha256(array_to_string(l[16 * k + 1:16 * k + 16], '')))
  FROM own WHERE len(l) > 1),
sub AS (SELECT grp, l[1] AS subroot, row_number() OVER (ORDER BY grp <> '-', encode(grp)) - 1 AS g FROM own WHERE len(l) = 1),
top(lvl, l) AS (
  SELECT 0, list(subroot ORDER BY g) FROM sub
  UNION ALL
  SELECT lvl + 1, list_transform(range(CAST(ceil(len(l) / 16.0) AS BIGINT)), lambda k: sha256(array_to_string(l[16 * k + 1:16 * k + 16], '')))
  FROM top WHERE len(l) > 1),
root AS (SELECT l[1] AS root FROM top WHERE len(l) = 1),
path(r, lvl, i, grp, tree, proof, fold) AS (
  SELECT r, 0, i, grp, 0, '', coalesce(changed, leaf) FROM f
  UNION ALL
  SELECT * FROM (
    SELECT p.r, p.lvl + 1, p.i // 16, p.grp, 0,
           proof || array_to_string(l[16 * (i // 16) + 1:i], '') || array_to_string(l[i + 2:16 * (i // 16) + 16], ''),
           sha256(array_to_string(l[16 * (i // 16) + 1:i], '') || fold || array_to_string(l[i + 2:16 * (i // 16) + 16], ''))
    FROM path p JOIN own o ON o.grp = p.grp AND o.lvl = p.lvl WHERE p.tree = 0 AND len(l) > 1
    UNION ALL
    SELECT p.r, 0, s.g, p.grp, 1, proof, fold
    FROM path p JOIN own o ON o.grp = p.grp AND o.lvl = p.lvl JOIN sub s ON s.grp = p.grp WHERE p.tree = 0 AND len(l) = 1
    UNION ALL
    SELECT p.r, p.lvl + 1, p.i // 16, p.grp, 1,
           proof || array_to_string(l[16 * (i // 16) + 1:i], '') || array_to_string(l[i + 2:16 * (i // 16) + 16], ''),
           sha256(array_to_string(l[16 * (i // 16) + 1:i], '') || fold || array_to_string(l[i + 2:16 * (i // 16) + 16], ''))
    FROM path p JOIN top o ON o.lvl = p.lvl WHERE p.tree = 1 AND len(l) > 1)),
done AS (SELECT r, proof, fold FROM path p JOIN top o ON o.lvl = p.lvl WHERE p.tree = 1 AND len(l) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM f JOIN done USING (r) JOIN sub USING (grp), root
"""

ORACLES = {"op12_merkle_manifest": OP12_SQL}
