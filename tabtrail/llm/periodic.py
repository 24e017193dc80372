"""Operator 11: periodic runs of words by online dyadic square catching.

A run is a stretch of consecutive words with smallest period q and at least ``max(least, times * q)``
words that no neighbouring word extends. A document is read as a stream of words. Whenever an
aligned block of 2^k words is complete, a catcher stands over it for the periods 2^k to 2^(k+1)-1
(the first blocks, of 8 words, also take 1 to 7): it keeps the periods at which the block's words
stood before, compares suffixes backwards from the block, and compares every word appended after it
with the word one period earlier until one differs. Words that agree over more than a period close
new squares; squares of one period that touch are one run. A run as defined holds a whole block
of its period's size behind its first period, so none is missed.

The words of a document are known when its task starts, so the catchers of one block size advance
together, in numpy, from small blocks to large ones: hashes of all windows of that size (two of
half the size make one) say which blocks stood before, and a catcher whose block and period lie inside a
known run of a smaller period is released, since it would only see that run again. Hashes are
a filter; a run's words are compared themselves. Work is n log n window comparisons and memory a few
arrays of n numbers for a document of n words, whatever its length; documents are independent, no
row moves. One task holds the texts of one Arrow batch.

Defined results: null and empty texts have no words and no runs; texts are read whole; repeated rows are
answered each; ties do not arise, a stretch has one smallest period; an empty table gives an empty
result. Only the id and text columns are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabtrail.llm.common import map_texts, prepare

LEAST = 24
TIMES = 3
FIRST = 8
#: Odd multipliers of the window hashes (any odd 64-bit numbers do).
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
JOIN = np.uint64(0xD1B54A32D192ED03)
SHIFT = np.uint64(29)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text (bytes split at exactly these)."""
    return text.split() if text else []


def word_numbers(words: list[bytes]) -> np.ndarray:
    """One number a distinct word."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _joined(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of ``2 * size`` words from those of ``size``."""
    left = sums[:-size] * JOIN
    left ^= left >> SHIFT
    left += sums[size:]
    return left


def _caught(sums: np.ndarray, size: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(block start, period) of each complete block of ``size`` whose hash stood a period before:
    periods ``size`` to ``2 * size - 1``, or those below ``size`` with ``short``."""
    blocks = sums[::size]
    skip = 1 if short else 2
    rows = blocks.size - skip
    if rows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = sums[1:1 + rows * size].reshape(rows, size)
    same = before == blocks[skip:, None]
    if short:
        same[:, -1] = False     # the block itself
    hit = np.flatnonzero(same)
    at = (hit // size + skip) * size
    return at, at - 1 - hit


def _segments(at: np.ndarray, period: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Catchers of one period over adjoining blocks as (first word, end, period)."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    cut = np.flatnonzero((np.diff(at) != size) | (np.diff(period) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, at.size] - 1
    return list(zip(at[first].tolist(), (at[last] + size).tolist(), period[first].tolist()))


def _advance(words: np.ndarray, i: int, p: int, step: int) -> int:
    """The first position from ``i`` on whose word differs from the one a period before."""
    while i < words.size:
        part = words[i:i + step]
        differ = part != words[i - p:i - p + part.size]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = i + part.size, 2 * step
    return i


def _retreat(words: np.ndarray, i: int, p: int, step: int) -> int:
    """The smallest position such that all words from it up to ``i`` equal those a period before."""
    while i > p:
        low = max(p, i - step)
        differ = (words[low:i] != words[low - p:i - p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, step = low, 2 * step
    return i


def find_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a word-number array, by start and period."""
    if least < 3 * FIRST - 2 or times < 3:
        raise ValueError("runs of at least 22 words and three periods")
    n = words.size
    if n < least:
        return []
    sums = words.astype(np.uint64) * MULTIPLY
    sums ^= sums >> SHIFT
    for size in (1, 2, 4):
        sums = _joined(sums, size)
    found: dict[tuple[int, int], int] = {}
    reach = np.zeros(n, np.int64)       # furthest end of a known run that starts here or before
    size, known = FIRST, False
    while size == FIRST or times * size <= n:
        at, period = _caught(sums, size, False)
        if size == FIRST:
            more = _caught(sums, size, True)
            at, period = np.concatenate([at, more[0]]), np.concatenate([period, more[1]])
        if at.size and known:
            free = reach[at - period] < at + size
            at, period = at[free], period[free]
        new = False
        todo = _segments(at, period, size) if at.size else []
        while todo:
            low, high, p = todo.pop()
            if (words[low:high] != words[low - p:high - p]).any():      # equal hashes, other words
                if high - low > size:
                    todo += [(x, x + size, p) for x in range(low, high, size)]
                continue
            start, end = _retreat(words, low, p, size) - p, _advance(words, high, p, size)
            if end - start >= max(least, times * p):
                found[start, end] = min(p, found.get((start, end), p))
                reach[start] = max(reach[start], end)
                new = True
        if new:
            np.maximum.accumulate(reach, out=reach)
            known = True
        if sums.size <= size:
            break
        sums = _joined(sums, size)
        size *= 2
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def mark_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document row: id, n_words, runs (start, length, period; by start and period) and
    collapsed (the kept words joined by one space)."""
    prepare(docs.sparkSession)

    def fn(ids: list, texts: list) -> dict:
        n, runs, kept = [], [], []
        for text in texts:
            words = split_words(text)
            own = find_runs(word_numbers(words), least, times)
            n.append(len(words))
            runs.append([{"start": s, "length": k, "period": p} for s, k, p in own])
            kept.append(b" ".join(collapse(words, own)))
        return {"n_words": pa.array(n, pa.int64()), "runs": pa.array(runs, RUNS_ARROW),
                "collapsed": pa.array(kept, pa.binary()).cast(pa.string())}

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary"))
    return map_texts(rows, fn, f"n_words bigint, runs {RUNS}, collapsed string")
