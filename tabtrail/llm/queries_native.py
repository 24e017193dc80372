"""Queries of operators 1 and 5."""

from __future__ import annotations

from tabtrail.llm import chat, sharding
from tabtrail.llm.common import prepare, table


def op1_chat_format(spark, sf_dir):
    prepare(spark)
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_sharding(spark, sf_dir):
    return sharding.shard_slots(table(spark, sf_dir, "documents"))


QUERIES = {"op1_chat_format": op1_chat_format, "op5_sharding": op5_sharding}

#: Prefixes restated as lists of turns; parts of 256 turns.
OP1_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
h AS (SELECT *, coalesce('+' || role, '-') AS rm, coalesce('+' || text, '-') AS tm FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(rm) || ':' || length(tm) || ':' || rm || ':' || tm)) AS pos FROM h),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS turns FROM n GROUP BY 1),
e AS (SELECT min(conv_id) AS conv_id, turns, count(*) AS n_copies FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(generate_series(1, len(turns) - 1)) AS k FROM c WHERE len(turns) > 1)),
k AS (SELECT conv_id, len(turns) AS n_turns, n_copies FROM e WHERE turns NOT IN (SELECT turns FROM p)),
b AS (SELECT conv_id, (pos - 1) // 256 AS part, min(pos) AS first_turn,
             string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
      FROM n GROUP BY 1, 2)
SELECT b.conv_id, part, first_turn,
       CAST(n_turns AS BIGINT) AS n_turns, n_copies, b.text
FROM b JOIN k ON b.conv_id IS NOT DISTINCT FROM k.conv_id
"""

#: The jump hash as a recursive chain in HUGEINT, the checksum as a fold over the bytes.
OP5_SQL = r"""
WITH RECURSIVE
tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t
        FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 255)) AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT r, doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
crc AS (
  SELECT r, doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS text_crc32
  FROM b, tab),
ids AS (SELECT DISTINCT coalesce(doc_id, 0) AS doc_id FROM documents),
jump(doc_id, key, b, j) AS (
  SELECT doc_id, CAST(doc_id AS HUGEINT) + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM ids
  UNION ALL
  SELECT doc_id, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM jump WHERE j <= 16)),
s AS (SELECT doc_id, CAST(max(b) FILTER (b < 16) AS INTEGER) AS shard, CAST(max(b) FILTER (b < 17) AS INTEGER) AS grown_shard FROM jump GROUP BY 1)
SELECT doc_id, size, text_crc32, law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size || ':' || text_crc32 || ':' || piece), 1, 8) AS BIGINT) % 1024,
                          doc_id NULLS FIRST, size, text_crc32, piece) - 1 AS slot
FROM (SELECT c.doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
             (row_number() OVER (PARTITION BY c.doc_id, size, text_crc32) - 1) // 4096 AS piece
      FROM crc c JOIN s ON s.doc_id = coalesce(c.doc_id, 0))
"""

ORACLES = {"op1_chat_format": OP1_SQL, "op5_sharding": OP5_SQL}
