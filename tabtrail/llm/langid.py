"""Operator 4: language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds its three letters' vectors,
rotated by their place, by multiplication; a text bundles its trigrams by adding them up; a
language's prototype bundles the unit vectors of its training texts; a text gets the
language whose prototype has the largest cosine with it. Letter vectors come from the code
point and a fixed seed, so every task makes the same ones and no table is sent around.

Bundling counts trigrams first (a text's vector is counts times trigram vectors), in chunks of
``CHARS`` characters and ``GRAMS`` trigrams, so memory does not follow a text's length or
the number of distinct trigrams.

Training takes about ``docs_per_lang`` texts of every language
(documented bounds): rows are counted per language and kept where the hash of the id falls in the
fraction that this leaves, so choosing them moves no text and gathers no language in one task.
Prototypes are summed in the tasks and only one vector a language reaches the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every
text if nothing was learned; equal cosines go to the first language by name; a negative
cosine scores 0; empty tables give empty results; repeated rows are labelled one by one.
Only id, text and (in training) lang are read, so other columns cannot clash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabtrail.llm.common import map_texts, prepare

DIMS = 1024
SEED = 20140
DOCS_PER_LANG = 400
#: Languages up to which their counts are broadcast.
LISTED = 10_000
#: Grades of the id hash by which training texts are chosen.
HASHES = 1 << 40
CHARS = 1 << 18
GRAMS = 4096
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself for letters, 0 (a boundary) for all else."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


@lru_cache(maxsize=8192)
def letter_vector(code: int, dims: int = DIMS) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, dims, np.int8) * 2 - 1).astype(np.int8)


def trigram_vectors(grams: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Bound vectors of packed trigrams (21 bits a letter), one row each."""
    out = np.ones((len(grams), dims), np.int8)
    for place in range(3):
        codes, at = np.unique(grams >> (21 * (2 - place)) & 0x1FFFFF, return_inverse=True)
        rows = np.stack([np.roll(letter_vector(int(c), dims), 2 - place) for c in codes])
        out *= rows[at]
    return out


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed trigrams of the letters of a text and their counts. Runs of other
    characters are one boundary; trigrams without a letter in the middle are left out."""
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    tail = np.zeros(1, np.int64)
    table = _letters()
    text = text or ""
    for i in range(0, len(text) + 1, CHARS):
        piece = text[i:i + CHARS].lower()
        codes = table[np.frombuffer(piece.encode("utf-32-le"), np.uint32)]
        codes = np.concatenate((tail, codes, [0] if i + CHARS > len(text) else []))
        codes = codes.astype(np.int64)
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        if len(codes) > 2:
            packed = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[codes[1:-1] != 0]
            g, c = np.unique(packed, return_counts=True)
            if len(grams):
                both, at = np.unique(np.concatenate((grams, g)), return_inverse=True)
                g, c = both, np.bincount(at, np.concatenate((counts, c))).astype(np.int64)
            grams, counts = g, c
        tail = codes[-2:]
    return grams, counts


def bundles(texts: list[str | None], dims: int = DIMS) -> np.ndarray:
    """Vector of each text (zero where it has no letter)."""
    found = [trigrams(t) for t in texts]
    out = np.zeros((len(texts), dims), np.float32)
    if not any(len(g) for g, _ in found):
        return out
    rows = np.repeat(np.arange(len(texts)), [len(g) for g, _ in found])
    every, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    counts = np.concatenate([c for _, c in found]).astype(np.float32)
    order = np.argsort(at, kind="stable")
    rows, at, counts = rows[order], at[order], counts[order]
    for k in range(0, len(every), GRAMS):
        a, z = np.searchsorted(at, (k, k + GRAMS))
        table = np.zeros((len(texts), min(GRAMS, len(every) - k)), np.float32)
        table[rows[a:z], at[a:z] - k] = counts[a:z]
        out += table @ trigram_vectors(every[k:k + GRAMS], dims).astype(np.float32)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def learn(labelled: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang",
          docs_per_lang: int = DOCS_PER_LANG, dims: int = DIMS, listed: int = LISTED) -> dict[str, np.ndarray]:
    """Prototype (unit vector) of every language of ``labelled``. The languages' counts are broadcast if there are
    ``listed`` at most."""
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).checkpoint()
    chosen = F.pmod(F.xxhash64("id"), F.lit(HASHES)) < F.lit(float(docs_per_lang) * HASHES) / F.col("n")
    if counts.count() <= listed:
        picked = rows.join(F.broadcast(counts), "lang").where(chosen)
    else:                                       # without a bound of the list: ids and languages move, then the texts by id
        ids = rows.select("id", "lang").join(counts, "lang").where(chosen).select("id", "lang").distinct()
        picked = rows.join(ids, ["id", "lang"], "left_semi")
    picked = picked.dropDuplicates(["id", "lang"])           # an id on very many rows is one text

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            vectors = unit(bundles(b.column(1).to_pylist(), dims)).astype(np.float64)
            for lang, v in zip(b.column(0).to_pylist(), vectors):
                sums[lang] = sums.get(lang, 0) + v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])],
                                             names=["lang", "v"])

    parts = picked.select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    summed = (parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i")
              .agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")))
    found = {r.lang: np.array([x.x for x in r.v], np.float32) for r in summed.collect()}
    return {k: unit(v[None])[0] for k, v in sorted(found.items()) if np.any(v)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, lang_pred, score) per document row."""
    prepare(docs.sparkSession)
    langs = sorted(prototypes)
    dims = len(next(iter(prototypes.values()))) if langs else DIMS
    known = np.stack([prototypes[k] for k in langs]).astype(np.float32) if langs else np.zeros((1, dims), np.float32)

    def run(_ids, texts):
        cosines = unit(bundles(texts, dims)) @ known.T
        best = np.round(cosines, 6).argmax(axis=1)
        some = cosines.any(axis=1) if langs else np.zeros(len(texts), bool)
        score = np.clip(cosines[np.arange(len(texts)), best], 0, 1) * some
        return {"lang_pred": pa.array([langs[i] if s else UNKNOWN for i, s in zip(best, some)], pa.string()),
                "score": pa.array(score.astype(np.float64))}

    return map_texts(docs.select(id_col, text_col), run, "lang_pred string, score double")
