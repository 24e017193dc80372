"""Operator 10: quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is one boolean expression over the text. On a bounded sample each rule is timed
and its share of rejected rows is counted; rules then run in the order of rejections per unit
of cost, inside one CASE expression, so a row stops at the first rule that rejects it. The
sample (``sample_rows`` different texts of at most ``SAMPLE_TEXT_BYTES`` bytes, chosen by hash over the
whole table, a documented bound) decides the order only: the verdict is the conjunction of all rules
and the same for every order.

Repeated 3-word windows are found inside the row: windows become 64-bit hashes, the sorted
hashes show equal neighbours, and the covered words are the lengths of the union of the
repeated windows. Nothing is shuffled, and a row's work is bounded by its own text.

Defined results: a null text has no words and is rejected like an empty one; ties and
repeated rows are judged one by one; an empty table gives an empty result; rules read the text
column only, so other columns cannot clash.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, functions as F

from tabtrail.llm.common import let
from tabtrail.session import checkpoint_dir

WORD_BREAK = r"[\x20\x09-\x0D]+"
BREAKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 256
SAMPLE_TEXT_BYTES = 1 << 16
#: A rule is timed over so many seconds at least, or over so many repeats of the sample.
TIMED_SECONDS = 0.1
MAX_REPEATS = 256
#: Thresholds of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_SHOUT_PERCENT = 30
MAX_EXCLAIM_PERCENT = 25
MAX_DUP_LINE_PERCENT = 50
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 15


def _long(c: Column) -> Column:
    return c.cast("bigint")


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def count_chars(text: Column, chars: str) -> Column:
    t = F.coalesce(text, F.lit(""))
    return _long(F.length(t) - F.length(F.translate(t, chars, "")))


def word_chars(text: Column) -> Column:
    return _long(F.length(F.translate(F.coalesce(text, F.lit("")), BREAKS, "")))


def _tail(a: Column, first: int) -> Column:
    return F.slice(a, F.lit(first), F.greatest(F.size(a), F.lit(1)))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array."""
    def covered(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(at, lambda s: F.flatten(F.zip_with(s, _tail(s, 2), lambda a, b: F.when(
            a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.expr("array()").cast("array<int>")))))
        return let(F.sort_array(F.array_distinct(twice)), lambda p: F.aggregate(
            F.zip_with(p, _tail(p, 2), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
            F.lit(0).cast("bigint"), lambda n, x: n + x))

    windows = F.transform(F.slice(F.arrays_zip(words.alias("a"), _tail(words, 2).alias("b"), _tail(words, 3).alias("c")),
                                  F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda x: F.xxhash64(x))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h),
                                         F.lit(0).cast("bigint")).otherwise(covered(h)))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.trim(x, F.lit(BREAKS))) > 0)


def dup_lines(lines: Column) -> Column:
    return _long(F.size(lines) - F.size(F.array_distinct(lines)))


@dataclass(frozen=True)
class Rule:
    """``rejects(text)`` is a boolean expression, never null."""
    name: str
    rejects: object


def _per_words(count, percent: int):
    return lambda t: 100 * count(t) > percent * _long(F.size(word_array(t)))


def _shouts(t: Column) -> Column:
    return F.regexp_count(F.coalesce(t, F.lit("")), F.lit(r"\p{Lu}{2,}"))


def _odd_mean(t: Column) -> Column:
    return let(_long(F.size(word_array(t))), lambda n: (word_chars(t) < MIN_MEAN_WORD * n)
               | (word_chars(t) > MAX_MEAN_WORD * n))


#: The two base rules, and those of the method's own verdict.
BASE_RULES = (
    Rule("few_words", lambda t: F.size(word_array(t)) < MIN_WORDS),
    Rule("repeated_windows", lambda t: let(word_array(t), lambda w: 100 * repeat_words(w)
                                           > MAX_REPEAT_PERCENT * _long(F.size(w)))),
)
OWN_RULES = (
    Rule("symbols", _per_words(lambda t: count_chars(t, SYMBOLS), MAX_SYMBOL_PERCENT)),
    Rule("shouting", _per_words(_shouts, MAX_SHOUT_PERCENT)),
    Rule("exclamations", _per_words(lambda t: count_chars(t, "!"), MAX_EXCLAIM_PERCENT)),
    Rule("duplicate_lines", lambda t: let(_lines(t), lambda x: 100 * dup_lines(x)
                                          > MAX_DUP_LINE_PERCENT * _long(F.size(x)))),
    Rule("mean_word_length", _odd_mean),
)


def sample_texts(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``sample_rows`` different texts (column ``t``) of at most ``SAMPLE_TEXT_BYTES`` bytes each:
    those of the smallest hashes over the whole table, in one partition, kept in the checkpoint folder. A
    first cut of the hash range leaves about four times as many rows, so few texts move, copies once."""
    checkpoint_dir(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("t")).where(F.octet_length("t") <= SAMPLE_TEXT_BYTES)
    highest = min(4 * sample_rows * 2**64 // max(1, docs.count()) - 2**63, 2**63 - 1)
    hashed = texts.select(F.xxhash64("t").alias("h"), "t").where(F.col("h") <= highest)
    return (hashed.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(sample_rows)
            .select("t").coalesce(1).checkpoint())


def measure(docs: DataFrame, rules, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost (seconds a row) and share of rejected rows of every rule on ``sample_texts``. A job repeats
    the sample as often as the rule needs to take ``TIMED_SECONDS`` more than a job without a rule, so that
    the start of a job does not weigh; the middle one of three such jobs counts. The first run of a rule,
    which compiles it, only counts rejections."""
    sample = sample_texts(docs, text_col, sample_rows)
    rows = max(1, sample.count())

    def timed(rejects: Column, times: int = 1) -> tuple[float, int]:
        repeated = sample.select("t", F.explode(F.sequence(F.lit(1), F.lit(times))))
        began = time.perf_counter()
        n = repeated.agg(F.sum(rejects.cast("bigint"))).first()[0] or 0
        return time.perf_counter() - began, n // times

    tests = [r.rejects(F.col("t")) for r in rules]
    rejected = [timed(t)[1] for t in tests]
    idle = median(timed(F.col("t").isNull())[0] for _ in range(3))
    found = []
    for rule, test, n in zip(rules, tests, rejected):
        once = timed(test)[0] - idle
        times = min(math.ceil(TIMED_SECONDS / max(once, 1e-3)), MAX_REPEATS)
        cost = (median(timed(test, times)[0] for _ in range(3)) - idle) / (rows * times)
        found.append({"rule": rule, "cost": max(cost, 1e-8), "rejects": n / rows})
    return found


def ordered(measured: list[dict]) -> list[Rule]:
    """Most rejections per unit of cost first; names decide ties."""
    return [m["rule"] for m in sorted(measured, key=lambda m: (-m["rejects"] / m["cost"], m["rule"].name))]


def first_rejection(rules, text: Column) -> Column:
    """Name of the first rule in order that rejects, else null; later rules stay unevaluated."""
    if not rules:
        return F.lit(None).cast("string")
    chain = F.when(rules[0].rejects(text), F.lit(rules[0].name))
    for r in rules[1:]:
        chain = chain.when(r.rejects(text), F.lit(r.name))
    return chain


def keep_good(docs: DataFrame, rules=BASE_RULES + OWN_RULES, *, text_col: str = "text",
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that some rule rejects, all columns kept."""
    order = ordered(measure(docs, rules, text_col, sample_rows))
    return docs.where(first_rejection(order, F.col(text_col)).isNull())


def assess(docs: DataFrame, own_rules=OWN_RULES, *, id_col: str = "doc_id", text_col: str = "text",
           sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, base verdict and verdict of every document row."""
    order = ordered(measure(docs, own_rules, text_col, sample_rows))
    t = F.col("text")
    m = (docs.select(F.col(id_col), F.col(text_col).alias("text"))
         .withColumn("m", let(word_array(t), lambda w: F.struct(
             _long(F.size(w)).alias("n_words"), repeat_words(w).alias("n_repeat_words")))))
    counted = m.select(id_col, "text", "m.n_words", word_chars(t).alias("word_chars"),
                       count_chars(t, SYMBOLS).alias("n_symbols"),
                       let(_lines(t), dup_lines).alias("n_dup_lines"), "m.n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(first_rejection(order, t).isNull())
    return judged.withColumn("kept", kept).drop("text")
