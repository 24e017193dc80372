"""Operator 7: benchmark decontamination.

The normalised word windows of the benchmark form a hash set that is broadcast: sorted 64-bit
hashes beside the benchmark's own normalised text. Every training text is cut into the same words,
the hashes of all its windows are looked up at once, each hit is verified by comparing the words
with the benchmark's text, and the matched spans or the whole documents are removed.

Size of the broadcast: the normalised benchmark is summed first. Up to ``block_bytes`` it is one
set, and the documents are scanned once. A window takes 24 bytes beside the text (8 hash, 12 place,
4 owner), so a set stays under 13 bytes a byte of text. Beyond ``block_bytes`` the benchmark is dealt into blocks of
about that size and the documents are scanned by one job a block, one set at a time; what a job
finds (by the SHA-256 of the text, hit texts only) is written to the checkpoint folder and joined
back. No item is left out, and long items come in pieces that overlap by a window, so a block stays near its size.
Cutting spans repeats these jobs on the texts that changed, until no window is left across a seam.

Defined results: null text, and text without a word, has no words and no hits. Repeated
documents are handled row by row. Items without words never occur; repeated item ids count
once; a null item id marks words but is not listed. Empty tables give empty results.
Only the id and text columns are read, so other columns cannot clash. The list of items that a
document contains is one row's result, however many items share a window.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from tabtrail.llm.common import prepare
from tabtrail.session import checkpoint_dir

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Windows of one piece of a long item.
PIECE_WORDS = 1 << 15
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
SPANS = "array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z (bytes.lower touches ASCII only)."""
    return WORD.findall(text.encode().lower()) if text else []


def window_hashes(ws: list[bytes], longest: int):
    """(n, hashes of all windows of n words) for n from 1 to ``longest``."""
    w = np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, len(ws))
    h = np.zeros(len(ws) + 1, np.uint64)
    for n in range(1, min(longest, len(ws)) + 1):
        h = h[:-1] * MIX + w[n - 1:]
        yield n, h


class Windows:
    """Distinct windows of one length, sorted by hash: where each one's words lie in the text
    of the set, and the numbers of the items it is from."""

    def __init__(self, text: bytes, hashes, starts, ends, items):
        order = np.lexsort((items, hashes))
        h, a, z, items = hashes[order], starts[order], ends[order], items[order]
        # Equal hashes stand together; where words differ all the same, they are told apart.
        group = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        twin = np.zeros(len(h), np.int32)
        first: dict[int, list[bytes]] = {}
        for i in np.flatnonzero(np.bincount(group)[group] > 1).tolist():
            known, key = first.setdefault(int(group[i]), []), text[a[i]:z[i]]
            if key not in known:
                known.append(key)
            twin[i] = known.index(key)
        order = np.lexsort((items, twin, group))
        h, a, z, items, twin = h[order], a[order], z[order], items[order], twin[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (twin[1:] != twin[:-1])))
        owned = new | np.concatenate(([True], items[1:] != items[:-1]))
        self.hashes, self.starts, self.ends = h[new], a[new], z[new]
        self.owners = items[owned]
        self.first_owner = np.append(np.flatnonzero(new[owned]), len(self.owners)).astype(np.uint32)


class WindowSet:
    """Exact set of benchmark windows, by window length."""

    def __init__(self, items, window: int = WINDOW):
        numbers: dict = {}
        parts: dict[int, list] = {}
        texts, at = [], 0
        for item_id, text in items:
            ws = words(text)
            if not ws:
                continue
            n = min(window, len(ws))
            *_, (_, h) = window_hashes(ws, n)
            size = np.fromiter(map(len, ws), np.int64, len(ws))
            start = at + np.concatenate(([0], np.cumsum(size[:-1] + 1)))
            parts.setdefault(n, []).append((h, start[:len(h)].astype(np.uint32), (start + size)[n - 1:].astype(np.uint32),
                                            np.full(len(h), numbers.setdefault(item_id, len(numbers)), np.uint32)))
            texts.append(b" ".join(ws))
            at += len(texts[-1]) + 1
        self.text, self.ids = b" ".join(texts), list(numbers)
        self.windows = {n: Windows(self.text, *map(np.concatenate, zip(*p))) for n, p in sorted(parts.items())}

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word ranges [start, end) covered by windows, and the items they are from."""
        ranges, owners = [], set()
        if not self.windows:
            return ranges, owners
        for n, h in window_hashes(ws, max(self.windows)):
            if n not in self.windows:
                continue
            known, found = self.windows[n], set()
            place = np.minimum(np.searchsorted(known.hashes, h), len(known.hashes) - 1)
            for i in np.flatnonzero(known.hashes[place] == h).tolist():
                key, p = b" ".join(ws[i:i + n]), int(place[i])
                while p < len(known.hashes) and known.hashes[p] == h[i]:
                    if self.text[known.starts[p]:known.ends[p]] == key:
                        ranges.append((i, i + n))
                        found.add(p)
                        break
                    p += 1
            for p in found:
                owners.update(known.owners[known.first_owner[p]:known.first_owner[p + 1]].tolist())
        return merge(ranges), {self.ids[o] for o in owners}


def merge(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (``i``, ``t``): item id and its normalised words, long items in pieces of
    ``PIECE_WORDS`` windows."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))

    def cut(batches):
        for b in batches:
            at, out = [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                ws = words(text)
                for a in range(0, max(len(ws) - window + 1, min(len(ws), 1)), PIECE_WORDS):
                    at.append(row)
                    out.append(b" ".join(ws[a:a + PIECE_WORDS + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(out, pa.string())],
                                             names=["i", "t"])

    return items.mapInArrow(cut, items.schema).distinct()


def window_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int,
                  block_bytes: int):
    """Window sets of the benchmark, one at a time, each from about ``block_bytes`` of
    normalised text at most. An empty benchmark has none."""
    prepare(benchmark.sparkSession)
    items = pieces(benchmark, item_col, text_col, window).checkpoint()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = math.ceil(total / block_bytes)
    dealt = items.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(max(blocks, 1))))
    filled = [r.k for r in dealt.select("k").distinct().orderBy("k").collect()] if blocks > 1 else range(blocks)
    for k in filled:
        yield WindowSet(((r.i, r.t) for r in dealt.where(F.col("k") == k).select("i", "t").collect()), window)


def only_block(blocks) -> tuple[WindowSet | None, list]:
    """(the set, []) of a benchmark that fits one set or has none, else (None, all blocks to come)."""
    blocks = iter(blocks)
    one, two = next(blocks, None), next(blocks, None)
    if two is None:
        return one or WindowSet(()), []

    def rest():
        yield one
        yield two
        yield from blocks
    return None, rest()


def text_key(text_col: str):
    return F.sha2(F.col(text_col).cast("binary"), 256)


def spans_column(spans) -> list[dict]:
    return [{"start": a, "end": z} for a, z in spans]


def block_hits(texts: DataFrame, blocks, item_type) -> DataFrame:
    """(``key``, ``spans``, ``items``) of every different text with a hit in some block, from rows
    (``key``, ``text``): one job a block, its hits written before the next set is sent."""
    spark = texts.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"
    schema = spark.createDataFrame([], f"key string, spans {SPANS}, items array<{item_type}>").schema
    names, arrow = [], to_arrow_schema(schema)
    for block in blocks:
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for b in batches:
                rows = []
                for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                    found, owners = held.value.scan(words(text.as_py()))
                    if found:
                        rows.append({"key": key, "spans": spans_column(found), "items": sorted(owners - {None})})
                yield pa.RecordBatch.from_pylist(rows, arrow)

        names.append(f"{folder}/block={len(names)}")
        texts.mapInArrow(run, schema).dropDuplicates(["key"]).write.parquet(names[-1])
        held.unpersist()

    def unite(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                r["spans"] = spans_column(merge((s["start"], s["end"]) for s in r["spans"]))
            yield pa.RecordBatch.from_pylist(rows, arrow)

    listed = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]     # one entry a block
    (spark.read.schema(schema).parquet(*names).groupBy("key").agg(*listed)
     .withColumn("items", F.sort_array(F.array_distinct("items")))
     .mapInArrow(unite, schema).write.parquet(f"{folder}/all"))
    return spark.read.schema(schema).parquet(f"{folder}/all")


def find_hits(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text",
              item_col="item_id", item_text_col="text", window: int = WINDOW,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: id, ``n_words``, ``spans`` (merged word ranges that lie in a
    benchmark window) and ``items`` (sorted ids of the items with an occurring window)."""
    spark = prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    one, blocks = only_block(window_blocks(benchmark, item_col, item_text_col, window, block_bytes))
    if one is None:
        return _joined_hits(docs, blocks, id_col, text_col, id_type, item_type)
    held = spark.sparkContext.broadcast(one)
    schema = spark.createDataFrame([], f"id {id_type}, n_words bigint, spans {SPANS}, items array<{item_type}>").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            n_words, spans, items = [], [], []
            for text in b.column(1):
                ws = words(text.as_py())
                found, owners = held.value.scan(ws)
                n_words.append(len(ws))
                spans.append(spans_column(found))
                items.append(sorted(owners - {None}))
            made = [pa.array(c, f.type) for c, f in zip((n_words, spans, items), list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=arrow.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _joined_hits(docs: DataFrame, blocks, id_col, text_col, id_type, item_type) -> DataFrame:
    """``find_hits`` over several blocks: words are counted in one more scan, hits are joined by the text's key."""
    hits = block_hits(docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")), blocks, item_type)

    def count(batches):
        for b in batches:
            n = pa.array([len(words(t.as_py())) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["id", "key", "n_words"])

    counted = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        count, f"id {id_type}, key string, n_words bigint")
    none = {"spans": SPANS, "items": f"array<{item_type}>"}
    return counted.join(hits, "key", "left").select(
        F.col("id").alias(id_col), "n_words", *[F.coalesce(c, F.expr("array()").cast(t)).alias(c) for c, t in none.items()])


def cut_spans(text: str, spans) -> str:
    """``text`` without the given word ranges; what is left is joined by one space."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.lower())]
    kept, at = [], 0
    for a, z in spans:
        kept.append(raw[at:places[a][0]])
        at = places[z - 1][1]
    kept.append(raw[at:])
    return b" ".join(k.strip() for k in kept if k.strip()).decode()


def clean_text(text: str | None, block: WindowSet) -> str | None:
    """``text`` without the stretches covered by benchmark windows, scanned again until no
    window is left across a seam."""
    while text and (spans := block.scan(words(text))[0]):
        text = cut_spans(text, spans)
    return text


def _cut_by_blocks(docs: DataFrame, text_col: str, first_blocks, more_blocks, item_type) -> DataFrame:
    """Spans cut over several blocks: all of them see the same text, then those texts that
    changed are scanned again, round by round, until none changes."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"

    def cut(batches):
        for b in batches:
            spans = ([(s["start"], s["end"]) for s in x] for x in b.column(2).to_pylist())
            texts = [cut_spans(t, s) for t, s in zip(b.column(1).to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    todo = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    rounds, blocks = [], first_blocks
    while True:
        hits = block_hits(todo.select(text_key("text").alias("key"), "text"), blocks, item_type)
        changed = todo.withColumn("now", text_key("text")).join(hits.select(F.col("key").alias("now"), "spans"), "now")
        changed.select("key", "text", "spans").dropDuplicates(["key"]).mapInArrow(cut, "key string, text string").write.parquet(
            f"{folder}/round={len(rounds)}")
        todo = spark.read.schema("key string, text string").parquet(f"{folder}/round={len(rounds)}")
        if todo.isEmpty():
            break
        rounds.append(todo.withColumn("round", F.lit(len(rounds))))
        blocks = more_blocks()
    if not rounds:
        return docs
    last = functools.reduce(DataFrame.union, rounds).groupBy("key").agg(F.max_by("text", "round").alias("text"))
    rows = docs.select(F.struct("*").alias("row"), text_key(text_col).alias("key")).join(last, "key", "left")
    return rows.select(*[F.coalesce(F.col("text"), F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) if c == text_col
                         else F.col("row")[c].alias(c) for c in docs.columns])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", *,
                  text_col="text", item_col="item_id", item_text_col="text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns and without benchmark passages. ``documents`` drops every
    row with a hit; ``spans`` cuts the hit words out of the text and keeps the row."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = prepare(docs.sparkSession)

    def make_blocks():
        return window_blocks(benchmark, item_col, item_text_col, window, block_bytes)

    one, blocks = only_block(make_blocks())
    if one is None:
        item_type = benchmark.schema[item_col].dataType.simpleString()
        if mode == "spans":
            return _cut_by_blocks(docs, text_col, blocks, make_blocks, item_type)
        hits = block_hits(docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")), blocks, item_type)
        rows = docs.select(F.struct("*").alias("row"), text_key(text_col).alias("key"))
        return rows.join(hits.select("key"), "key", "left_anti").select("row.*")
    at = docs.columns.index(text_col)
    held = spark.sparkContext.broadcast(one)

    def cut(batches):
        for b in batches:
            texts = pa.array([clean_text(t, held.value) for t in b.column(at).to_pylist()], b.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    def drop(batches):
        for b in batches:
            clean = [not held.value.scan(words(t))[0] for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(cut if mode == "spans" else drop, docs.schema)


def digest(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Columns of query op7 from ``find_hits``: counts, and SHA-256 over the item ids in
    string order."""
    listed = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return hits.select(id_col, "n_words", n_hit.alias("n_hit"),
                       F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(listed, 256).alias("items_sha256"),
                       (F.size("spans") > 0).alias("contaminated"))


def items_digest(items) -> str:
    """Brute-force form of the item digest, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
