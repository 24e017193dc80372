"""Operator 3: toxicity by a weighted finite-state pattern grammar.

Lexicon transducers read a word and emit a class with a weight: insults (words and word stems
with weights learned from labels), threats, targets, negation and reported speech. Clause transducers
read the classes of one clause: ``negation`` keeps a scope of a few words, ``reported`` holds to
the end of the clause (through a colon), ``targeted`` waits for insult and addressee in either order, ``threat``
for a threat and an addressee, and both remember whether the insult or threat was negated or reported. Their composition is one deterministic machine whose arcs carry weights in
a vector of evidence kinds; the weight of the path of each clause is its score, and a document is
scored by a logistic function of the matched clauses, fitted on labels. So a negated or
reported insult counts as much as the labels say, starting from a prior that discounts it.

Learning is bounded: at most ``per_class`` labelled texts of each class (smallest hash of the id);
features are counted in the tasks, and only ``CANDIDATES`` features and, for the texts of the sample,
small vectors reach the driver. Support is counted over distinct neighbourhoods of a word, so words
that merely come along with copies of one text do not enter the lexicon; the features are cut to
``CANDIDATES`` after that, so that they take no place from others.

Defined results: null and empty texts match no clause and get the score of no evidence;
texts are read whole; repeated rows are scored one by one; without labels the prior weights
hold and no insult is known; empty tables give empty results. Only id and text are scored,
so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabtrail.llm.common import map_texts, prepare

PER_CLASS = (8000, 4000)    # clean, toxic
CANDIDATES = 4000
HASHES = 1 << 20
MIN_SUPPORT = 3
MIN_LOG_ODDS = 3.0
MIN_SURE = 1.0
SAME_SHARE = 0.9
STEMS = (3, 4, 5, 6, 7, 8)
SCOPE = 3
THRESHOLD = 0.7

#: Closed word classes in the languages of the corpus.
THREATS = "kill murder shoot stab strangle töten umbringen erschießen tuer poignarder étrangler matar apuñalar".split()
TARGETS = ("you your yours u ur he she him her they them du dich dir ihr euch sie er tu te toi vous il elle "
           "tú ti usted ustedes vosotros ella ellos").split()
NEGATIONS = "not no never isn ain aren don doesn nicht kein keine nie niemals pas jamais non nunca jamás tampoco".split()
REPORTS = ("said says say called wrote quoted quote claimed reported sagte sagt schrieb behauptete dit disait écrit "
           "dijo dice escribió").split()

WORD = re.compile(r"[^\W\d_]+")
#: A colon ends no clause: what a report announces by it is reported.
CLAUSE = re.compile(r"[^.!?;\n]+")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: Evidence kinds: the components of a path's weight; ``DENSITY`` is added per document.
PLAIN, NEGATED, REPORTED, TARGETED, THREATENED = range(5)
KINDS = 5
#: Prior of the logistic weights: intercept, the kinds, density of all matches.
PRIOR = np.array([-4.0, 2.0, 1.0, 1.0, 0.5, 3.0, 1.0])


class Machine:
    """Deterministic transducer: ``arcs[state][class] -> (next state, emission)``. Emissions
    are sets of marks; composition runs machines side by side and joins their marks."""

    def __init__(self, start, step):
        self.start, self.arcs = start, {}
        todo = [start]
        while todo:
            s = todo.pop()
            if s in self.arcs:
                continue
            self.arcs[s] = [step(s, c) for c in range(OTHER + 1)]
            todo.extend(n for n, _ in self.arcs[s])

    def compose(self, other: "Machine") -> "Machine":
        def step(s, c):
            (a, x), (b, y) = self.arcs[s[0]][c], other.arcs[s[1]][c]
            return (a, b), x | y
        return Machine((self.start, other.start), step)


NONE = frozenset()


def grammar(scope: int = SCOPE) -> Machine:
    """Composition of the clause transducers."""
    insult = Machine(0, lambda s, c: (0, frozenset({"insult"}) if c == INSULT else NONE))
    negation = Machine(0, lambda s, c: (scope, NONE) if c == NEGATION else (
        max(0, s - 1), frozenset({"negated"}) if s and c in (INSULT, THREAT) else NONE))
    reported = Machine(0, lambda s, c: (1 if s or c == REPORT else 0, frozenset({"reported"}) if s else NONE))

    def aimed(first, mark):
        """``first`` and a target in one clause, in any order. The state remembers whether ``first`` was negated or
        reported, since the target may come later: the mark is given once for a plain ``first``, and
        ``void`` once where there is no other."""
        def step(s, c):
            left, told, met, target, given = s
            if c == first:
                now = 2 if left else 3 if told else 1
                met = 1 if now == 1 else met or now
            target, told = target or c == TARGET, told or c == REPORT
            left = scope if c == NEGATION else max(0, left - 1)
            give = NONE
            if met and target and given < (2 if met == 1 else 1):
                give, given = frozenset({mark if met == 1 else f"{mark} void {met}"}), 2 if met == 1 else 1
            return (left, told, met, target, given), give
        return Machine((0, False, 0, False, 0), step)

    out = insult
    for m in (negation, reported, aimed(INSULT, "targeted"), aimed(THREAT, "threat")):
        out = out.compose(m)
    return out


class Lexicon:
    """Word transducer: word -> (class, weight). Insult features are whole words, or stems
    written with a final ``*``."""

    def __init__(self, insults: dict[str, float]):
        self.words = {}
        for cls, listed in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.words.update((w, (cls, 1.0)) for w in listed)
        self.words.update((w, (INSULT, x)) for w, x in insults.items() if not w.endswith("*"))
        self.stems = {w[:-1]: x for w, x in insults.items() if w.endswith("*")}
        marks = [*self.stems, *(w for w in insults if not w.endswith("*")), *THREATS]
        self.heads = {m[:3] for m in marks}

    def read(self, word: str) -> tuple[int, float]:
        got = self.words.get(word)
        if got:
            return got
        weight = max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)
        return (INSULT, weight) if weight else (OTHER, 0.0)

    def may_match(self, words) -> bool:
        heads = self.heads
        return any(w[:3] in heads and self.read(w)[0] in (INSULT, THREAT) for w in words)


class Grammar:
    """Lexicon and clause machine together: matched clauses of a text and their weights."""

    def __init__(self, insults: dict[str, float]):
        self.lexicon, self.machine = Lexicon(insults), grammar()

    def clause(self, words: list[str]) -> np.ndarray:
        """Path weight of one clause; an insult repeated in it counts once."""
        weight, state, arcs = np.zeros(KINDS), self.machine.start, self.machine.arcs
        seen = set()
        for w in words:
            cls, x = self.lexicon.read(w)
            state, marks = arcs[state][cls]
            if "insult" in marks and w not in seen:
                seen.add(w)
                kind = NEGATED if "negated" in marks else REPORTED if "reported" in marks else PLAIN
                weight[kind] += x
            if "targeted" in marks:
                weight[TARGETED] += 1
            if "threat" in marks:
                weight[THREATENED] += 1
            if "threat void 2" in marks:
                weight[NEGATED] += 1
            if "threat void 3" in marks:
                weight[REPORTED] += 1
        return weight

    def matches(self, text: str | None) -> list[tuple[str, np.ndarray]]:
        """Clauses with some evidence, in order; clauses that are repeated word for word, once."""
        if not text:
            return []
        lower = text.lower()
        if not self.lexicon.may_match(set(WORD.findall(lower))):
            return []
        clauses = dict.fromkeys(c.strip() for c in CLAUSE.findall(lower))
        scored = ((c, self.clause(WORD.findall(c))) for c in clauses)
        return [(c, w) for c, w in scored if w[[PLAIN, NEGATED, REPORTED, THREATENED]].any()]

    def evidence(self, text: str | None) -> np.ndarray:
        """Logarithms of the path weights by kind, and of the sum of the plain ones (not negated, not reported) per
        hundred words."""
        total = sum((w for _, w in self.matches(text)), np.zeros(KINDS))
        n = len(WORD.findall(text)) if total.any() else 1
        plain = total[PLAIN] + total[TARGETED] + total[THREATENED]
        return np.log1p(np.append(total, 100 * plain / max(n, 1)))


class Model:
    def __init__(self, insults: dict[str, float], weights: np.ndarray = PRIOR):
        self.insults, self.weights = insults, np.asarray(weights)
        self.grammar = Grammar(insults)

    def score(self, text: str | None) -> float:
        z = self.weights[0] + self.grammar.evidence(text) @ self.weights[1:]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(text: str | None) -> set[str]:
    """Whole words of three letters or more, and stems."""
    found = set()
    for w in set(WORD.findall(text.lower())) if text else ():
        if len(w) >= STEMS[0]:
            found.add(w)
            found.update(w[:k] + "*" for k in STEMS if len(w) > k)
    return found


def _sample(docs, labels, id_col, text_col, label_col, per_class):
    """Labelled texts (label, text), at most ``per_class`` of each class."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    # twice the rows needed pass by hash, the smallest hashes of them are taken
    share = [min(1.0, 2 * per_class[k] / max(1, counts.get(k, 0))) for k in (0, 1)]
    picks = [known.where((F.col("label") == k) & (F.pmod(F.xxhash64("id"), F.lit(HASHES)) <= int(share[k] * HASHES)))
             .orderBy(F.pmod(F.xxhash64("id"), F.lit(HASHES)), "id").limit(per_class[k]) for k in (0, 1)]
    ids = picks[0].unionByName(picks[1])          # sum(per_class) rows at most: small enough to broadcast
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # an id on very many rows is one text, the smallest
    return (rows.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
            .select("label", "text").checkpoint(), counts)


def _candidates(sample: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Features (feature) that toxic texts have far more often."""
    def run(batches):
        seen = Counter()
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.update((f, label) for f in features(text))
            if len(seen) > 500_000:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    counted = sample.mapInArrow(run, "feature string, label int, n bigint").groupBy("feature").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"))
    return (counted.where(F.col("pos") >= MIN_SUPPORT)
            .where(_odds(F.col("pos"), F.col("neg"), sizes) >= MIN_LOG_ODDS).select("feature"))


def _odds(pos, neg, sizes: dict[int, int]):
    return F.log((pos + 0.5) / (sizes[1] + 1)) - F.log((neg + 0.5) / (sizes[0] + 1))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f for f, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.int32()),
         pa.array(list(seen.values()), pa.int64())], names=["feature", "label", "n"])


def _contexts(sample: DataFrame, candidates: DataFrame, sizes: dict[int, int]) -> dict[str, float]:
    """Candidates counted again over distinct neighbours (the word before, the word after; the rarer
    side counts) in place of texts: a word that comes along with copies of one passage has one
    neighbour on some side. Kept if the log odds less their standard error stay above ``MIN_SURE``, and of
    these the ``CANDIDATES`` with the largest support times odds. Neighbours are counted by word;
    those of a stem are the sum over its words."""
    def run(batches):
        for b in batches:
            seen = set()
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = WORD.findall(text.lower())
                for before, w, after in zip(["", *ws], ws, [*ws[1:], ""]):
                    if len(w) >= STEMS[0]:
                        seen.add((w, label, 0, before))
                        seen.add((w, label, 1, after))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.int32()),
                 pa.array([x[2] for x in seen], pa.int32()), pa.array([x[3] for x in seen], pa.string())],
                names=["word", "label", "side", "near"])

    near = sample.mapInArrow(run, "word string, label int, side int, near string").distinct()
    words = near.groupBy("word", "side").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    stems = [F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS]
    sides = (words.where("pos > 0 OR neg > 0")
             .select("side", "pos", "neg", F.explode(F.array_compact(F.array(F.col("word"), *stems))).alias("feature"))
             .groupBy("feature", "side").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    counted = (sides.groupBy("feature").agg(F.min("pos").alias("pos"), F.max("neg").alias("neg"))
               .join(candidates, "feature").checkpoint())
    core = F.regexp_replace("feature", r"\*$", "")
    starts = [F.when(F.length(core) >= k, F.concat(F.substring(core, 1, k), F.lit("*"))) for k in STEMS]
    longer = (counted.select("feature", "pos", F.explode(F.array_compact(F.array(*starts))).alias("stem"))
              .where("stem != feature").groupBy("stem").agg(F.max("pos").alias("longest")))
    pos, neg = F.col("pos"), F.col("neg")
    odds = _odds(pos, neg, sizes)
    sure = odds - F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    found = (counted.join(longer, F.col("feature") == F.col("stem"), "left")
             .where(F.coalesce("longest", F.lit(0)) < SAME_SHARE * pos)      # a stem of one word only says what the word says
             .where((pos >= MIN_SUPPORT) & (odds >= MIN_LOG_ODDS) & (sure >= MIN_SURE))
             .select("feature", odds.alias("odds"), (pos * odds).alias("rank")).orderBy(F.desc("rank"), "feature").limit(CANDIDATES))
    return {r.feature: r.odds for r in found.collect()}


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps, drawn towards ``PRIOR``."""
    x = np.column_stack((np.ones(len(x)), x))
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + strength * (w - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return np.maximum(w, [-np.inf, 0.5, 0, 0, 0, 0, 0])


def learn(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic",
          per_class: tuple[int, int] = PER_CLASS) -> Model:
    """Model from the texts that ``labels`` (id, 0 or 1) marks."""
    prepare(docs.sparkSession)
    sample, known = _sample(docs, labels, id_col, text_col, label_col, per_class)
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model({})
    insults = _contexts(sample, _candidates(sample, sizes), sizes)
    model = Grammar(insults)

    def run(batches):
        for b in batches:
            x = np.array([model.evidence(t) for t in b.column(1).to_pylist()]).reshape(-1, KINDS + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, x.T)], names=["label", *names])

    names = [f"k{i}" for i in range(KINDS + 1)]
    rows = sample.mapInArrow(run, "label int, " + ", ".join(f"{n} double" for n in names)).collect()
    data = np.array([tuple(r) for r in rows])
    share = np.where(data[:, 0] == 1, known.get(1, 1) / sizes[1], known.get(0, 1) / sizes[0])
    share *= len(data) / share.sum()
    return Model(insults, _fit(data[:, 1:], data[:, 0], share))


def score(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, n_clauses) per document row."""
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)     # lexicon of CANDIDATES features at most

    def run(_ids, texts):
        scores = [held.value.score(t) for t in texts]
        return {"score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())}

    return map_texts(docs.select(id_col, text_col), run, "score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, *, text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows scored at ``threshold`` or more."""
    spark = prepare(docs.sparkSession)
    held, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            clean = [held.value.score(t) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
