"""Queries of operators 6 and 8."""

from __future__ import annotations

from tabtrail.llm import html_extract as hx, warc
from tabtrail.llm.common import table


def op6_warc(spark, sf_dir):
    back = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return hx.extract(pages, hx.learn(pages))


QUERIES = {"op6_warc": op6_warc, "op8_html_extract": op8_html_extract}
#: What the archives hold, without writing any: SHA-1 digits regrouped from 4 to 5 bits for base32.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes,
         array_to_string(list_transform(string_split(sha1(html), ''),
           lambda c: right('000' || bin(CAST('0x' || c AS BIGINT)), 4)), '') AS bits FROM p),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_reduce(list_prepend(0, list_transform(
             string_split(substr(bits, 5 * i + 1, 5), ''), lambda x: CAST(x AS BIGINT))), lambda a, x: 2 * a + x) AS INTEGER), 1)), '')
         AS payload_digest FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS n,
             first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first_id END AS refers_to
FROM r
"""

#: The labelled region itself, as the pages of the table mark it.
OP8_SQL = r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ') AS inner_html FROM pages),
b AS (
  SELECT page_id, url, list_filter(list_transform(string_split_regex(inner_html, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
           regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
                          '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

ORACLES = {"op6_warc": OP6_SQL, "op8_html_extract": OP8_SQL}
