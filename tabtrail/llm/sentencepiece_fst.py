"""Operator 2: SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (space to the marker, marker in
front of the text, optional squeezing of spaces), the pieces (a trie whose arcs spell a piece and
write its id) and byte fallback (a character that no piece spells writes its bytes). Each input is
composed with them into a lattice whose arcs run from one character position to a later one,
and the tropical-semiring shortest path through it is the encoding.

Weights. In a unigram model an arc weighs the negative score of its piece. A BPE model has no path
score (its scores order merges), so there a fourth machine takes part, whose states are pieces: an
arc weighs 0 if the piece before it and its own piece are what merging their joint text gives, and
infinity if not. Each prefix of an input then has exactly one path of finite weight, the result of
the merges, so the shortest path is the library's encoding; a test compares them.

Composition is done per segment: no piece has a marker after another character, nor a line break
or tab, so every path passes the state before such a place (checked when compiling; a model where
it does not hold is composed with whole texts). Segments and piece pairs are remembered per
worker in tables of a fixed size. Decoding writes the pieces' bytes and reverses the normaliser.

Defined results: null and empty texts have no pieces; decoding gives the text back unless it holds
the marker character itself, which reads as a space; repeated rows are encoded one by one; an
empty table gives an empty result. Only id and text are read by ``encode``.
"""

from __future__ import annotations

import math
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tabtrail.llm.common import prepare

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SEGMENTS = 300_000      # remembered segments and pairs in a worker
REMEMBERED = 64         # characters of the longest segment that is remembered
PAIRS = 1_000_000
#: Fixed values of the model file: piece kinds and model kinds.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of the protocol-buffer fields of a message."""
    i = 0

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size = varint()
            yield key >> 3, data[i:i + size]
            i += size


class Transducer:
    """Compiled model: ``encode(text) -> ids``, ``decode(ids) -> text``."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, kinds = [], [], []
        trainer, normaliser = {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2):
            raise ValueError("normalisers with a character map are not supported")
        if USER in kinds or UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.unknown = kinds.index(UNKNOWN)
        self.byte_ids = [i for i, k in enumerate(kinds) if k == BYTE]
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        self.trie = {p[:k]: -1 for p in self.ids for k in range(1, len(p))}
        self.trie.update(self.ids)
        self.floor = min((self.scores[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        self.written = [p.encode() for p in self.pieces]
        for value, i in enumerate(self.byte_ids):
            self.written[i] = bytes([value])
        for i, k in enumerate(kinds):
            if k == CONTROL:
                self.written[i] = b""
        self.written[self.unknown] = " ⁇ ".encode()
        inner = "".join(self.ids)
        apart = "".join(c for c in "\n\t\r" if c not in inner)
        whole = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.segment = None if whole else re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" + f"|[{apart}]" * bool(apart))
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    # -- normaliser ---------------------------------------------------------------------
    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    # -- merges of a short string, for the pair machine -----------------------------------
    def merged(self, text: str) -> list[str]:
        parts = list(text)
        ids, scores = self.ids, self.scores
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and scores[i] > best:
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may stand after ``a``; characters without a piece (negative)
        may stand anywhere."""
        if a < 0 or b < 0:
            return True
        key = a * len(self.pieces) + b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            p, q = self.pieces[a], self.pieces[b]
            got = self.pairs[key] = self.merged(p + q) == [p, q]
        return got

    # -- composition and shortest path -----------------------------------------------------
    def path(self, text: str) -> list[int]:
        """Arc labels of the shortest path: piece ids, or -1 - code point for characters that
        no piece spells. Arcs are made when their state is reached."""
        label, back = (self._merge_path if self.kind == BPE else self._score_path)(text)
        out, i = [], len(text)
        while i:
            out.append(label[i])
            i = back[i]
        return out[::-1]

    def _merge_path(self, text: str):
        """Weights 0 and infinity: each position has one label of finite weight, so states are
        taken depth first, longest arc first, until the end is reached."""
        n, trie, pairs, size, follows = len(text), self.trie, self.pairs, len(self.pieces), self.follows
        label, back = [None] * (n + 1), [0] * (n + 1)
        label[0] = -1
        stack = [0]
        while label[n] is None:
            i = stack.pop()
            before, j = label[i], i + 1
            arc = trie.get(text[i])
            if (arc is None or arc < 0) and label[j] is None:
                label[j], back[j] = -1 - ord(text[i]), i
                stack.append(j)
            while arc is not None:
                if arc >= 0 and label[j] is None:
                    free = before < 0 or pairs.get(before * size + arc)
                    if free is None:
                        free = follows(before, arc)
                    if free:
                        label[j], back[j] = arc, i
                        stack.append(j)
                j += 1
                if j > n:
                    break
                arc = trie.get(text[i:j])
        return label, back

    def _score_path(self, text: str):
        """Weights are negative scores: positions in order, least weight kept."""
        n, trie, scores, inf = len(text), self.trie, self.scores, math.inf
        weight, label, back = [0.0] + [inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            base, j = weight[i], i + 1
            arc = trie.get(text[i])
            if (arc is None or arc < 0) and base - self.floor < weight[j]:
                weight[j], label[j], back[j] = base - self.floor, -1 - ord(text[i]), i
            while arc is not None:
                if arc >= 0 and base - scores[arc] < weight[j]:
                    weight[j], label[j], back[j] = base - scores[arc], arc, i
                j += 1
                if j > n:
                    break
                arc = trie.get(text[i:j])
        return label, back

    def spelled(self, text: str) -> list[int]:
        out: list[int] = []
        for a in self.path(text):
            if a >= 0:
                out.append(a)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in chr(-1 - a).encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def packed(self, segment: str) -> bytes:
        if len(segment) > REMEMBERED:             # texts without spaces: whole lines, which hardly come again
            return np.array(self.spelled(segment), np.int32).tobytes()
        got = self.known.get(segment)
        if got is None:
            if len(self.known) >= SEGMENTS:
                self.known.clear()
            got = self.known[segment] = np.array(self.spelled(segment), np.int32).tobytes()
        return got

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        text = self.normalise(text) if text else ""
        if not text:
            return b""
        if self.segment is None or not self.byte_ids:     # unknown runs may cross segments
            return np.array(self.spelled(text), np.int32).tobytes()
        return b"".join(map(self.packed, self.segment.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids) -> str:
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def _encoded(t: Transducer, texts) -> tuple[pa.Array, pa.Array, pa.Array]:
    packs = [t.encode_bytes(x) for x in texts]
    sizes = np.array([len(p) // 4 for p in packs], np.int64)
    values = np.frombuffer(b"".join(packs), np.int32)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    same = [t.decode(np.frombuffer(p, np.int32).tolist()) == (x or "") for p, x in zip(packs, texts)]
    return (pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(sizes), pa.array(same, pa.bool_()))


def read_model(path: str = MODEL_PATH) -> bytes:
    """Model file, read once by the driver (about half a megabyte) and broadcast."""
    with open(path, "rb") as f:
        return f.read()


def fresh(name: str, taken) -> str:
    while name in taken:
        name += "_"
    return name


def add_pieces(docs: DataFrame, model: bytes, *, text_col="text") -> DataFrame:
    """``docs``, all columns, and ``piece_ids``, ``n_pieces``, ``round_trip`` (whether
    decoding gives the text back). A name that ``docs`` has already gets underscores."""
    spark = prepare(docs.sparkSession)
    held, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)
    names = [fresh(n, docs.columns) for n in ("piece_ids", "n_pieces", "round_trip")]
    schema = docs.select("*").schema
    for n, kind in zip(names, (T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType())):
        schema = schema.add(n, kind)

    def run(batches):
        t = compiled(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *_encoded(t, b.column(at).to_pylist())],
                                             names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, model: bytes, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, piece_ids, n_pieces, round_trip) per document row."""
    return add_pieces(docs.select(id_col, text_col), model, text_col=text_col).drop(text_col)


def decode(encoded: DataFrame, model: bytes, *, ids_col="piece_ids", text_col="text") -> DataFrame:
    """``encoded`` plus the decoded text; null ids give an empty text."""
    spark = prepare(encoded.sparkSession)
    held, at = spark.sparkContext.broadcast(model), encoded.columns.index(ids_col)
    name = fresh(text_col, encoded.columns)
    schema = encoded.select("*").schema.add(name, T.StringType())

    def run(batches):
        t = compiled(held.value)
        for b in batches:
            texts = [t.decode(x or []) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, name])

    return encoded.mapInArrow(run, schema)
