"""Operator 13: line dedup with two Bloom filters.

A line's key is the line without white space at its ends, in lower case (A-Z). Keys found in at least
``min_docs`` document rows lose their lines: all of them, or with ``keep="first"`` all but the first line of
the first document.

1. Every task sets the hashes of its documents' keys in a once-seen filter; a hash whose bits were all set
   before goes to a twice-seen filter as well. A key counts once a document.
2. The tasks' filters are merged slice by slice: a bit belongs to the twice-seen filter if any task has
   set it there or two tasks have it in their once-seen filters. Any key of two documents has all its
   bits there; others may, by chance.
3. Keys that pass the twice-seen filter are suspected repeats. Only they are shuffled, counted before by batch
   and task, and confirmed by the keys themselves, so that chance and equal hashes cost time only.
4. A scan drops the lines of the confirmed keys.

The filters have ``BITS_PER_LINE`` bits a line, between ``LEAST_BITS`` and ``MOST_BITS`` (64 MB, the bound of the
broadcast filter). Beyond 3.3e7 lines they fill up and more lines are suspected; results do not change.
Confirmed keys are broadcast if they take ``most_bytes`` at most, which is checked; beyond, the
suspected lines are joined with them (dealt over ``SALT`` copies, since a key may stand in a third of all
documents) and the numbers of the lines to drop are joined to the texts, numbered in a written table. Both
ways give the same lines. The driver holds the twice-seen filter and what it broadcasts.

Defined results: a null or empty text is one empty line, whose key is empty; keys of fewer than
``min_chars`` code points keep their lines; every row is a document of its own, repeated rows too; among
documents with the smallest id each keeps its first line (a null id comes last); long texts and lines
are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabtrail.llm.common import map_texts, prepare
from tabtrail.session import checkpoint_dir

MIN_DOCS = 10
BITS_PER_LINE = 16
LEAST_BITS = 1 << 20
MOST_BITS = 1 << 29
SLICE_WORDS = 1 << 12
MOST_BYTES = 16 << 20
SALT = 16
SPACE = b" \t\n\x0b\x0c\r"
#: Bits of a key inside its 64-bit word, taken from four places of the hash.
PLACES = (40, 46, 52, 58)


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of every line of a text."""
    return [line.strip(SPACE).lower() for line in (text or b"").split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars) and key != b""


def document_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    """The distinct keys of a text that may be dropped."""
    return {k for k in line_keys(text) if _long_enough(k, min_chars)}


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def bits_of(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, mask) of each hash in a filter of ``words`` 64-bit words (a power of two)."""
    mask = np.zeros(h.size, np.uint64)
    for p in PLACES:
        mask |= np.uint64(1) << ((h >> np.uint64(p)) & np.uint64(63))
    return (h & np.uint64(words - 1)).astype(np.int64), mask


class Filters:
    """A once-seen and a twice-seen filter."""

    def __init__(self, words: int):
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def add(self, h: np.ndarray) -> None:
        h, n = np.unique(h, return_counts=True)
        at, mask = bits_of(h, self.once.size)
        again = (n > 1) | (self.once[at] & mask == mask)
        np.bitwise_or.at(self.twice, at[again], mask[again])
        np.bitwise_or.at(self.once, at, mask)

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once


def passes(twice: np.ndarray, h: np.ndarray) -> np.ndarray:
    at, mask = bits_of(h, twice.size)
    return twice[at] & mask == mask


def filter_words(lines: int) -> int:
    bits = min(max(BITS_PER_LINE * lines, LEAST_BITS), MOST_BITS)
    return 1 << ((bits - 1).bit_length() - 6)


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, words: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, words * 8, codec="zstd", asbytes=True), np.uint64)


def twice_seen(texts: DataFrame, words: int, min_chars: int) -> np.ndarray:
    """The merged twice-seen filter of a one-column frame of texts (binary)."""
    part = min(words, SLICE_WORDS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(words)
        for b in batches:
            own.add(hashes([k for t in b.column(0).to_pylist() for k in document_keys(t, min_chars)]))
        for s in range(words // part):
            once, twice = (a[s * part:(s + 1) * part] for a in (own.once, own.twice))
            if once.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "once": [_pack(once)], "twice": [_pack(twice)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, Filters] = {}
        for b in batches:
            for s, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                merged.setdefault(s, Filters(part)).merge(_unpack(once, part), _unpack(twice, part))
        for s, f in merged.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "twice": [_pack(f.twice)]})

    slices = (texts.mapInArrow(build, "slice int, once binary, twice binary").repartition("slice")
              .mapInArrow(merge, "slice int, twice binary"))
    whole = np.zeros(words, np.uint64)
    for s, data in slices.toLocalIterator():
        whole[s * part:(s + 1) * part] = _unpack(bytes(data), part)
    return whole


def repeated_keys(rows: DataFrame, twice, min_docs: int, min_chars: int) -> DataFrame:
    """(key, n, first_id) of the keys in at least ``min_docs`` rows of a frame (id, text); ``twice`` is the
    broadcast filter."""
    id_type = rows.schema[0].dataType.simpleString()

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter = Counter()
            first: dict = {}
            for i, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                keys = list(document_keys(t, min_chars))
                for k in np.array(keys, object)[passes(twice.value, hashes(keys))]:
                    count[k] += 1
                    if k not in first or d is not None and (first[k][0] is None or d < first[k][0]):
                        first[k] = d, i
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64()),
                 b.column(0).take(pa.array([first[k][1] for k in count], pa.int64()))], names=["key", "n", "id"])

    return (rows.mapInArrow(suspect, f"key binary, n bigint, id {id_type}").groupBy("key")
            .agg(F.sum("n").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= min_docs))


def _without(text: bytes | None, gone) -> tuple[int, int, bytes]:
    """(lines, dropped lines, kept text); ``gone(keys)`` gives a flag a line."""
    lines = (text or b"").split(b"\n")
    flags = gone([line.strip(SPACE).lower() for line in lines])
    kept = [line for line, g in zip(lines, flags) if not g]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _columns(done: list[tuple[int, int, bytes]]) -> dict:
    n, dropped, kept = zip(*done) if done else ((), (), ())
    return {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()),
            "text": pa.array(kept, pa.binary()).cast(pa.string())}


KEPT = "n_lines bigint, n_dropped bigint, text string"


def _flags(keys: list[bytes], spared: bool, held) -> list[bool]:
    """Which lines go: those whose key is held, but for the first line of each key in a spared document."""
    out, seen = [], set()
    for k in keys:
        first = spared(k) and k not in seen if spared else False
        seen.add(k)
        out.append(k in held and not first)
    return out


def _drop_by_broadcast(rows: DataFrame, confirmed: DataFrame, keep: str) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast({bytes(k): d for k, d in confirmed.select("key", "first_id").toLocalIterator()})

    def fn(ids: list, texts: list) -> dict:
        done = []
        for d, t in zip(ids, texts):
            spared = (lambda k: k in held.value and held.value[k] == d) if keep == "first" else None
            done.append(_without(t, lambda keys: _flags(keys, spared, held.value)))
        return _columns(done)

    return map_texts(rows, fn, KEPT)


def _drop_by_join(rows: DataFrame, confirmed: DataFrame, twice, keep: str, folder: str) -> DataFrame:
    spark = rows.sparkSession
    id_name, id_type = rows.columns[0], rows.schema[0].dataType.simpleString()
    rows.select(F.col(id_name).alias("id"), F.col(rows.columns[1]).alias("text")).withColumn(
        "row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    numbered = spark.read.parquet(f"{folder}/rows")

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {"row": [], "line": [], "key": [], "head": [], "of": []}
            for i, (r, t) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                keys, seen = line_keys(t), set()
                for j in np.flatnonzero(passes(twice.value, hashes(keys))).tolist():
                    for name, v in zip(found, (r, j, keys[j], keys[j] not in seen, i)):
                        found[name].append(v)
                    seen.add(keys[j])
            ids = b.column(1).take(pa.array(found.pop("of"), pa.int64()))
            arrays = [pa.array(found["row"], pa.int64()), pa.array(found["line"], pa.int64()),
                      pa.array(found["key"], pa.binary()), pa.array(found["head"], pa.bool_()), ids]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "line", "key", "head", "id"])

    lines = (numbered.select("row", "id", "text").mapInArrow(suspect, f"row bigint, line bigint, key binary, head boolean, id {id_type}")
             .withColumn("copy", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")))
    copies = confirmed.select("key", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("copy"))
    gone = lines.join(copies, ["key", "copy"])
    if keep == "first":
        gone = gone.where(~(F.col("head") & F.col("id").eqNullSafe(F.col("first_id"))))
    gone = gone.groupBy("row").agg(F.collect_list("line").alias("gone"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                numbers = set(g or ())
                done.append(_without(t, lambda keys: [i in numbers for i in range(len(keys))]))
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(done).values()], names=[id_name, "n_lines", "n_dropped", "text"])

    joined = numbered.join(gone, "row", "left").select("id", "text", "gone")
    return joined.mapInArrow(drop, f"`{id_name}` {id_type}, {KEPT}")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                min_chars: int = 1, keep: str = "none", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per document row: id, n_lines, n_dropped and text, the kept lines."""
    if keep not in ("none", "first") or min_docs < 2:
        raise ValueError("keep is 'none' or 'first', min_docs two or more")
    spark = prepare(docs.sparkSession)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__text"))
    text = F.col(text_col).cast("string")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0
    twice = spark.sparkContext.broadcast(twice_seen(rows.select("__text"), filter_words(lines), min_chars))
    repeated_keys(rows, twice, min_docs, min_chars).write.parquet(f"{folder}/keys")
    confirmed = spark.read.parquet(f"{folder}/keys")
    held = confirmed.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    if held <= most_bytes:
        return _drop_by_broadcast(rows, confirmed, keep)
    return _drop_by_join(rows, confirmed, twice, keep, folder)
