"""Inverted-list index over session vectors with multi-probe search and exact scores.

* ``fit`` learns ``lists`` directions (spherical k-means) from at most ``sample`` vectors, those of
  smallest id hash, and the number of lists a question must probe: the fewest that hold ``recall``
  of the best ``k`` matches of ``CALIBRATE`` sample vectors. Clustered vectors need few probes, vectors
  without structure many; the figure comes from the data.
* ``build`` writes every vector, normalised, below its nearest direction (``list=``), so that a search
  reads the probed lists only. A list comes in parts of about ``PART_ROWS`` rows: copies of one vector,
  however many, are spread over tasks.
* ``search`` brings the parts of a list together with the questions that probe it, in blocks of questions; each such
  group gives ``k`` rows a question, by exact cosine, so pairs are neither shuffled nor sorted. With
  ``exact=True`` a second round probes every list that could still hold a match better than a question's k-th: a
  list's vectors lie within a known angle of its direction, which bounds their cosine. Its result is that of
  ``retrieval.similar_sessions`` on vectors that have a direction.

Null, empty and zero vectors, and those of another length, have no cosine and are not indexed. What is
broadcast is at most ``MOST_LISTS`` directions and one size and angle a list.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabtrail.constants import SIMILAR_TOP_K
from tabtrail.operators.retrieval import _flatten_match, _unit, best_in_blocks, question_block, question_blocks
from tabtrail.operators.stats import top_n
from tabtrail.session import checkpoint_dir

SAMPLE = 8192
MOST_LISTS = 4096
CALIBRATE = 128
ROUNDS = 10
PART_ROWS = 8192
#: Rounding of the bound: a list is left out only if it is worse by more than this.
SLACK = 1e-9


@dataclass
class IndexModel:
    """Directions (lists x dimensions), lists to probe, recall of those probes on the sample; after
    ``build`` also the size of each list and the smallest cosine to its direction."""

    directions: np.ndarray
    probes: int
    sample_recall: float
    sizes: dict[int, int] = field(default_factory=dict)
    cosines: dict[int, float] = field(default_factory=dict)

    def lists(self, spark: SparkSession) -> DataFrame:
        """One row a list that holds vectors: its number of parts and the angle it spans."""
        rows = [(j, -(-n // PART_ROWS), float(np.arccos(np.clip(self.cosines[j], -1, 1)))) for j, n in self.sizes.items()]
        return F.broadcast(spark.createDataFrame(rows, "list int, parts int, width double"))


def with_unit(v: DataFrame, values: str, dims: int | None = None) -> DataFrame:
    """``v`` with ``_v``, its vector of length 1; rows whose vector has no direction (or not ``dims`` places) go."""
    x = F.col(values)
    ok = (F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists(x, lambda a: a != 0))
    return v.filter(ok if dims is None else ok & (F.size(x) == dims)).withColumn("_v", _unit(x))


def _directions(x: np.ndarray, lists: int) -> np.ndarray:
    c = x[:lists].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def _ranks(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """For the first vectors, the place of the list of each of their best ``k`` others in their probe order."""
    q = x[:CALIBRATE]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -2.0
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    order = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    return np.take_along_axis(order, (x @ c.T).argmax(1)[best], axis=1)


def fit(v: DataFrame, k: int = SIMILAR_TOP_K, recall: float = 0.95, lists: int | None = None,
        sample: int = SAMPLE) -> IndexModel:
    """Learn an index of vectors (id, values) for the best ``k`` matches. ``lists`` defaults to the square root of
    the number of vectors; the sample's commonest length is the length of all."""
    rows = [r[0] for r in with_unit(v, "values").orderBy(F.xxhash64("id"), "id").limit(sample).select("_v").collect()]
    if not rows:
        return IndexModel(np.zeros((0, 0)), 0, 1.0)
    lengths = [len(r) for r in rows]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n))
    x = np.unique(np.array([r for r in rows if len(r) == dims]), axis=0)
    x = x[np.random.default_rng(0).permutation(len(x))]
    n = lists or int(v.count() ** 0.5)
    c = _directions(x, max(1, min(n, MOST_LISTS, len(x))))
    if len(x) < 2:
        return IndexModel(c, 1, 1.0)
    ranks = _ranks(x, c, min(k, len(x) - 1))
    reached = [float((ranks < p).mean()) for p in range(1, len(c) + 1)]
    probes = next(p for p, r in enumerate(reached, 1) if r >= recall or p == len(c))
    return IndexModel(c, probes, reached[probes - 1])


def _nearest(c: np.ndarray):
    @pandas_udf("struct<list:int,near:double>")
    def run(v: pd.Series) -> pd.DataFrame:
        s = np.stack(v.to_list()) @ c.T if len(v) else np.zeros((0, len(c)))
        return pd.DataFrame({"list": s.argmax(1).astype(np.int32), "near": s.max(1)})
    return run


def _probed(c: np.ndarray):
    """Lists from the nearest on, with their cosines."""
    @pandas_udf("array<struct<list:int,near:double>>")
    def run(v: pd.Series) -> pd.Series:
        s = np.stack(v.to_list()) @ c.T if len(v) else np.zeros((0, len(c)))
        order = np.argsort(-s, axis=1, kind="stable")
        return pd.Series([[{"list": int(j), "near": float(row[j])} for j in o] for row, o in zip(s, order)])
    return run


def build(v: DataFrame, model: IndexModel, path: str) -> DataFrame:
    """Write the index of vectors (id, values, metadata) to ``path`` and complete ``model``; returns the index rows."""
    spark = v.sparkSession
    if not len(model.directions):
        empty = v.withColumn("_v", _unit(F.col("values"))).select("id", "_v", "metadata", F.lit(0).alias("list")).limit(0)
        empty.write.parquet(path)
        return spark.read.parquet(path)
    x = with_unit(v, "values", model.directions.shape[1]).withColumn("_n", _nearest(model.directions)("_v"))
    (x.select("id", "_v", "metadata", F.col("_n.near").alias("near"), F.col("_n.list").alias("list"))
     .write.partitionBy("list").parquet(path))
    index = spark.read.parquet(path)
    known = index.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()
    model.sizes, model.cosines = {r.list: r.n for r in known}, {r.list: r.near for r in known}
    return index


def _round(index: DataFrame, lists: DataFrame, wanted: DataFrame, blocks: int, k: int, start: int | None) -> DataFrame:
    """The best ``k`` rows of each question's lists (question_id, _q, list)."""
    x = index if start is None else index.filter(F.col("metadata.timestamp") >= F.lit(start))
    probed = F.broadcast(wanted.select("list", question_block(blocks).alias("_b")).distinct())
    x = x.join(probed, "list").join(lists.select("list", "parts"), "list").select(
        "id", "metadata", "_v", "list", "_b", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    dealt = wanted.join(lists.select("list", "parts"), "list").select(
        "question_id", "_q", "list", question_block(blocks).alias("_b"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return top_n(best_in_blocks(x, dealt, ["list", "part", "_b"], k), k, [F.col("score").desc(), F.col("id")],
                 ["question_id"], rank_col="rank")


def search(index: DataFrame, model: IndexModel, questions: DataFrame, k: int = SIMILAR_TOP_K, start: int | None = None,
           probes: int | None = None, exact: bool = False) -> DataFrame:
    """The best ``k`` matches of each question (question_id, query_vec) in the shape of ``similar_sessions``."""
    if not model.sizes:
        none = questions.select("question_id").join(index.select("id", "metadata"), F.lit(False))
        return _flatten_match(none.withColumns({"score": F.lit(0.0), "rank": F.lit(0).cast("long")}), ["question_id", "rank"])
    qs = (with_unit(questions.select("question_id", "query_vec"), "query_vec", model.directions.shape[1])
          .select("question_id", F.col("_v").alias("_q")).withColumn("_l", _probed(model.directions)("_q")))
    lists, probes = model.lists(index.sparkSession), max(1, probes or model.probes)
    blocks = question_blocks(questions)
    best = _round(index, lists, qs.select("question_id", "_q", F.explode(F.slice("_l", 1, probes)["list"]).alias("list")), blocks, k, start)
    if exact:
        kth = best.filter(F.col("rank") == k).select("question_id", F.col("score").alias("_kth"))
        rest = qs.join(kth, "question_id", "left").select(
            "question_id", "_q", "_kth", F.explode(F.slice("_l", probes + 1, len(model.directions))).alias("_p"))
        rest = rest.select("question_id", "_q", "_kth", "_p.list", "_p.near").join(lists, "list")
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("near")))) - F.col("width")
        bound = F.cos(F.greatest(F.lit(0.0), angle)) + SLACK
        more = rest.filter(F.col("_kth").isNull() | (bound >= F.col("_kth"))).select("question_id", "_q", "list")
        both = best.drop("rank").unionByName(_round(index, lists, more, blocks, k, start).drop("rank"))
        best = top_n(both, k, [F.col("score").desc(), F.col("id")], ["question_id"], rank_col="rank")
    return _flatten_match(best, ["question_id", "rank"])


def search_by_index(v: DataFrame, questions: DataFrame, path: str, k: int = SIMILAR_TOP_K,
                    start: int | None = None, exact: bool = False) -> DataFrame:
    """Fit, build and search in one call. The vectors are checkpointed: fitting and building both read them."""
    checkpoint_dir(v.sparkSession)
    v = v.select("id", "values", "metadata").checkpoint()
    model = fit(v, k)
    return search(build(v, model, path), model, questions, k, start, exact=exact)
