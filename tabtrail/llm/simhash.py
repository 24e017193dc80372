"""Operator 9: SimHash near-duplicates by a byte-position inverted index.

A fingerprint is 8 positional bytes. If two differ in at most ``k`` bits, at most ``k`` of
their bytes differ, so at least ``8 - k`` positional bytes are shared: the guaranteed
minimum. The index posts every *distinct* fingerprint under tuples of positional bytes
rather than under single ones (one byte value holds 1/256 of everything, a list that grows
with the square of the input). The tuples are chosen so that any ``8 - k`` shared positions
contain one of them: with the positions in two halves, every triple inside a half (8 keys of
24 bits for k = 3). Within a posting list the shared positional bytes of pairs are tallied,
pairs below the minimum are rejected, and the rest is verified on the bit distance.

Dense lists never emit their pairs. A list yields one edge per member, to the smallest
fingerprint it reaches *through verified links inside the list*; the components of these
edges are the components of the links. Lists longer than ``list_rows`` are dealt again on two
more shared positional bytes (10 keys of 40 bits): the members of such a list differ in three
bytes, so it has 2^24 members at most whatever the corpus holds.

Defined results: null and word-less texts have fingerprint zero and are linked like others;
one or two words form one shingle; repeated rows and equal texts share a fingerprint; a null
id is never the smallest (a component of null ids only has a null id); an empty table gives
an empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tabtrail.llm.common import map_texts, prepare
from tabtrail.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BYTES = 8
CHUNK = 1 << 14          # hashes unpacked to bits at a time
LIST_ROWS = 1 << 16      # longest posting list handled in one task before it is dealt again


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text as a signed integer."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return 0
    joined = b" ".join(ws)
    n = min(shingle, len(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = list(zip(starts[:len(ws) - n + 1].tolist(), ends[n - 1:].tolist()))
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(cuts), CHUNK):
        part = np.array([h(joined[a:z], SEED) for a, z in cuts[i:i + CHUNK]], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > len(cuts), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, fp bigint) per document row."""
    prepare(docs.sparkSession)
    return map_texts(docs.select(id_col, text_col),
                     lambda ids, texts: {"fp": pa.array([fingerprint(t, shingle) for t in texts], pa.int64())},
                     "fp bigint")


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Byte-position tuples of which every set of ``8 - max_bits`` positions contains one:
    all tuples of half the guaranteed minimum (rounded up) inside each half of the bytes."""
    if not 0 <= max_bits < BYTES:
        raise ValueError("max_bits must be 0 to 7")
    size = -(-(BYTES - max_bits) // 2)
    return [*combinations(range(4), size), *combinations(range(4, 8), size)]


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _postings(fps: DataFrame, sets, tag: str) -> DataFrame:
    """(list number, masked fingerprint, fp), one row for each position tuple."""
    made = [F.struct(F.lit(i).alias(tag), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias(tag + "_bytes"))
            for i, s in enumerate(sets)]
    return fps.select("fp", *[c for c in fps.columns if c != "fp"], F.inline(F.array(*made)))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def reach(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """For distinct ``fps`` (uint64) of one posting list: the smallest member reached through
    links of at most ``max_bits`` bits. Each member is compared with those not reached yet:
    shared positional bytes are tallied first, the bit distance verifies."""
    fps = np.sort(fps.view(np.int64)).view(np.uint64)
    root = fps.copy()
    left = np.arange(len(fps))
    while len(left):
        first, left = left[0], left[1:]
        frontier = [first]
        while frontier and len(left):
            x = fps[left] ^ fps[frontier.pop()]
            shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            near = shared >= BYTES - max_bits
            near[near] = _bits(x[near]) <= max_bits
            frontier.extend(left[near].tolist())
            root[left[near]] = fps[first]
            left = left[~near]
    return np.column_stack((fps, root)).view(np.int64)


def _list_edges(max_bits: int):
    """Arrow function over rows (list key columns..., fp) sorted by list: one edge for each
    member of a list that reaches a smaller one. A list may span batches; it is carried."""

    def edges_of(keys: np.ndarray, fps: np.ndarray):
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = np.concatenate(([0], cut, [len(fps)]))
        pairs = [np.empty((0, 2), np.int64)]
        for a, z in zip(bounds[:-1], bounds[1:]):
            if z - a > 1:
                got = reach(fps[a:z].view(np.uint64), max_bits)
                pairs.append(got[got[:, 0] != got[:, 1]])
        return np.concatenate(pairs)

    def run(batches):
        held_k = held_f = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            keys, fps = np.column_stack(cols[:-1]), cols[-1]
            if held_f is not None:
                keys, fps = np.concatenate((held_k, keys)), np.concatenate((held_f, fps))
            changes = np.flatnonzero((keys != keys[-1]).any(axis=1))
            at = changes[-1] + 1 if len(changes) else 0
            held_k, held_f = keys[at:], fps[at:]
            if at:
                yield _edge_batch(edges_of(keys[:at], fps[:at]))
        if held_f is not None and len(held_f):
            yield _edge_batch(edges_of(held_k, held_f))

    return run


def _edge_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def link_edges(fps: DataFrame, max_bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) whose components are those of all
    links of at most ``max_bits`` bits."""
    sets = position_sets(max_bits)
    posted = _postings(fps.select("fp"), sets, "set")
    key = ["set", "set_bytes"]
    sizes = posted.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    held = posted.join(sizes, key)
    short = held.where(F.col("n") <= list_rows).select(*key, F.lit(-1).alias("sub"),
                                                       F.lit(0).cast("bigint").alias("sub_bytes"), "fp")
    more = max(0, BYTES - max_bits - len(sets[0]))
    deeper = [(i, s, extra) for i, s in enumerate(sets)
              for extra in combinations([p for p in range(BYTES) if p not in s], more)]
    by_set = F.array(*[F.array(*[F.struct(F.lit(j).alias("sub"),
                                          F.col("fp").bitwiseAND(F.lit(_mask(extra))).alias("sub_bytes"))
                                 for j, (i, _, extra) in enumerate(deeper) if i == k])
                       for k in range(len(sets))])
    long = (held.where(F.col("n") > list_rows)
            .select(*key, "fp", F.inline(F.element_at(by_set, F.col("set") + 1)))
            .select(*key, "sub", "sub_bytes", "fp"))
    lists = (short.unionByName(long).repartition(*key, "sub", "sub_bytes")
             .sortWithinPartitions(*key, "sub", "sub_bytes"))
    return lists.mapInArrow(_list_edges(max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """(id, fp, root, component_id) per document row: ``root`` is the component's smallest
    fingerprint, ``component_id`` the smallest id in it."""
    found = fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle).checkpoint()
    distinct = found.groupBy("fp").agg(F.min(id_col).alias("low")).checkpoint()
    roots = components(link_edges(distinct, max_bits, list_rows))
    placed = (distinct.join(roots, distinct.fp == roots.node, "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    # written first, so that both sides of the join come straight from an exchange and the planner can split a
    # component that holds a third of all fingerprints
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id")).checkpoint()
    return (found.join(placed.select("fp", "root").join(lowest, "root"), "fp")
            .select(id_col, "fp", "root", "component_id"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest id.
    Ids that come on several rows are told apart by fingerprint, and of rows equal in both
    one stays."""
    marked = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle,
                             max_bits=max_bits).checkpoint()
    keep = (marked.where(F.col(id_col).eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min(F.struct(F.col(id_col).alias("id"), "fp")).alias("k"))
            .select("k.id", "k.fp"))
    times = marked.groupBy(id_col).agg(F.count("*").alias("n")).select(F.col(id_col).alias("id"), "n")
    chosen = keep.join(times, keep.id.eqNullSafe(times.id)).select(keep.id.alias("keep_id"), "fp", "n").checkpoint()
    names = docs.columns
    left = docs.select(F.struct(*names).alias("doc"))
    once = left.join(chosen.where("n = 1"), F.col(f"doc.{id_col}").eqNullSafe(F.col("keep_id")), "left_semi")
    many = chosen.where("n > 1")
    again = left.join(many.select("keep_id").distinct(),
                      F.col(f"doc.{id_col}").eqNullSafe(F.col("keep_id")), "left_semi").select("doc.*")
    again = _one_each(again, many, id_col, text_col, shingle)
    return once.select("doc.*").unionByName(again)


def _one_each(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """For ids on several rows: the rows whose (id, fingerprint) was chosen, one of each."""
    at = docs.columns.index(text_col)
    schema = f"doc struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in docs.schema)}>, own bigint"

    def run(batches):
        for b in batches:
            own = pa.array([fingerprint(t, shingle) for t in b.column(at).to_pylist()], pa.int64())
            doc = pa.StructArray.from_arrays(b.columns, names=b.schema.names)
            yield pa.RecordBatch.from_arrays([doc, own], names=["doc", "own"])

    marked = docs.mapInArrow(run, schema)
    held = marked.join(chosen.select("keep_id", "fp"),
                       F.col(f"doc.{id_col}").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("fp")), "left_semi")
    return (held.groupBy(F.col(f"doc.{id_col}").alias("i"), "own")
            .agg(F.first("doc").alias("doc")).select("doc.*"))
