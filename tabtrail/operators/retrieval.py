"""Session text, vectors, similarity search and reflection contexts.

* ``session_text`` (K1) is a native ``concat_ws`` over optional lines.
* Vectors are rows ``(id, values array<float>, metadata struct)``; ``similar_sessions``
  (K3) is an exact cosine top-k. Questions scoped to a user are joined to that user's
  vectors on ``user_id`` (an equi-join); a stated set of global questions is scored against all
  vectors in a grid of blocks, each of which keeps a question's best ``k`` before anything is sorted. Top-k
  uses ``row_number`` (Spark applies it per partition before the shuffle).
* ``context_stats`` (A6) / ``reflection_context`` (X1) / ``weekly_context`` (X3) build the
  reflection text per user from all rows of the range; only the listed sites (5 a category)
  and matches (k) are limited.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrail import constants as const
from tabtrail.constants import (
    CONTEXT_SITES_PER_CATEGORY,
    DEFAULT_CATEGORY_NAME,
    NO_ACTIVITY_CONTEXT,
    REFLECTION_HISTORY_LIMIT,
    SIMILAR_TOP_K,
    VECTOR_DEFAULT_SOURCE,
    VECTOR_DEFAULT_TITLE,
)
from tabtrail.functions.formats import format_hm, minutes_rounded
from tabtrail.functions.time import iso_ts
from tabtrail.operators.categorize import FAILED, row_by_row
from tabtrail.operators.dimension import upsert
from tabtrail.operators.stats import top_n, with_category
from tabtrail.session import ship_package

KEYS = ("user_id",)
#: Most questions and about as many vectors as meet in one task; scores held at once.
QUESTION_BLOCK = 4096
VECTOR_BLOCK = 8192
SCORES_AT_ONCE = 2_000_000
#: More than a matrix product differs from the sum taken place by place, for vectors of length 1.
ROUNDING = 1e-9


def _truthy(c: Column, numeric: bool = False) -> Column:
    """JavaScript truthiness: strings are falsy when null or ''; numbers when null or 0."""
    return c.isNotNull() & ((c != 0) if numeric else (c != ""))


def session_text(title: Column, url: Column, duration: Column, category: Column,
                 timestamp: Column, notes: Column | None = None) -> Column:
    """K1: 'Browsing session' + optional Title/URL lines, DurationMinutes, optional
    Category/Notes/Timestamp lines, joined by newlines."""
    def line(label, value, cond):
        return F.when(cond, F.concat(F.lit(label), value.cast("string")))
    return F.concat_ws(
        "\n",
        F.lit(const.SESSION_TEXT_HEAD),
        line(const.SESSION_TEXT_TITLE, title, _truthy(title)),
        line(const.SESSION_TEXT_URL, url, _truthy(url)),
        F.concat(F.lit(const.SESSION_TEXT_DURATION),
                 minutes_rounded(F.coalesce(duration, F.lit(0))).cast("string")),
        line(const.SESSION_TEXT_CATEGORY, category, _truthy(category)),
        line(const.SESSION_TEXT_NOTES, notes, _truthy(notes)) if notes is not None else F.lit(None),
        line(const.SESSION_TEXT_TIME, iso_ts(timestamp), _truthy(timestamp, numeric=True)),
    )


def vector_records(emb: DataFrame, s: DataFrame, c: DataFrame,
                   now_ms: int | None = None) -> DataFrame:
    """Vector rows keyed by session id with defaulted metadata (title 'Untitled
    session', category 'Uncategorized', duration 0, source 'browser_session' unless the
    sessions have a ``source`` of their own)."""
    source = F.col("source") if "source" in s.columns else F.lit(None).cast("string")
    sj = with_category(s, c, ("name",)).select(
        F.col("id").alias("_sid"), "user_id", "url", "title", "duration", "timestamp",
        F.col("category_name"), source.alias("_source"))
    x = emb.join(sj, emb["vec_id"] == sj["_sid"], "left")
    ts = F.coalesce(F.nullif(F.col("timestamp"), F.lit(0)),
                    F.lit(now_ms).cast("long") if now_ms is not None else F.lit(None).cast("long"))
    meta = F.struct(
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(VECTOR_DEFAULT_TITLE)).alias("title"),
        F.col("url").alias("url"),
        ts.alias("timestamp"),
        F.coalesce(F.col("duration"), F.lit(0).cast("long")).alias("duration"),
        F.coalesce(F.nullif(F.col("category_name"), F.lit("")),
                   F.lit(DEFAULT_CATEGORY_NAME)).alias("category"),
        F.coalesce(F.nullif(F.col("_source"), F.lit("")), F.lit(VECTOR_DEFAULT_SOURCE)).alias("source"),
        F.col("user_id").alias("user_id"),
    )
    return x.select(F.col("vec_id").cast("string").alias("id"),
                    F.col("embedding").alias("values"), meta.alias("metadata"))


def upsert_vectors(current: DataFrame, new: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Keyed upsert on ``id``: new rows replace current ones, the last of each id by ``order``."""
    return upsert(current, new, ["id"], order)


def vector_id(id_: Column, url: Column, timestamp: Column) -> Column:
    """Key of a vector: the session id, else ``url-timestamp``."""
    return F.coalesce(id_.cast("string"), F.concat_ws("-", url, timestamp.cast("string")))


def _unit(v: Column) -> Column:
    """A vector as doubles of length 1 (null for a zero vector)."""
    d = F.transform(v, lambda x: x.cast("double"))
    return F.transform(F.array(d), lambda x: F.transform(F.array(F.sqrt(F.aggregate(
        x, F.lit(0.0), lambda a, y: a + y * y))), lambda n: F.transform(x, lambda y: y / F.nullif(n, F.lit(0.0))))[0])[0]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def _flatten_match(x: DataFrame, extra: Sequence[str]) -> DataFrame:
    m = F.col("metadata")
    return x.select(*extra, F.col("id"), F.col("score"), m["title"].alias("title"),
                    m["url"].alias("url"), m["timestamp"].alias("timestamp"),
                    m["duration"].alias("duration"), m["category"].alias("category"))


def question_blocks(questions: DataFrame) -> int:
    return max(1, -(-questions.count() // QUESTION_BLOCK))


def question_block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("question_id", "_q"), F.lit(blocks)).cast("int")


def _matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length; a null vector or one with a null place is in none."""
    c = pa.concat_arrays(vectors.chunks)
    at = np.asarray(c.offsets, np.int64)
    nulls = np.concatenate([[0], np.cumsum(~np.asarray(c.values.is_valid(), bool))])
    whole = np.asarray(c.is_valid(), bool) & (nulls[at[1:]] == nulls[at[:-1]])
    flat, size, out = c.values.fill_null(0.0).to_numpy(zero_copy_only=False), np.diff(at), {}
    for n in np.unique(size[whole]).tolist():
        rows = np.flatnonzero(whole & (size == n))
        out[n] = rows, flat[at[rows][:, None] + np.arange(n)]
    return out


def _first_of_key(key: np.ndarray, k: int) -> np.ndarray:
    """Whether a row is among the first ``k`` of its key."""
    order = np.argsort(key, kind="stable")
    same = key[order]
    low = np.searchsorted(same, same)
    keep = np.empty(len(key), bool)
    keep[order] = np.arange(len(key)) - low < k
    return keep


def _top(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question row, vector row, score) of the ``k`` best vectors of each question: by score (NaN first), then by
    row. A matrix product chooses whom to score, allowing for its rounding; scores are the sums of ``_dot``."""
    rows = np.arange(len(v))
    if v.shape[1]:      # equal vectors tie everywhere, so the first k of them are enough
        raw = np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel()
        rows = rows[_first_of_key(np.unique(raw, return_inverse=True)[1].ravel(), k)]
    else:
        rows = rows[:k]
    v, step, found = v[rows], max(1, SCORES_AT_ONCE // max(1, len(rows))), []
    for low in range(0, len(q), step):
        part = q[low:low + step]
        near = part @ v.T
        near[np.isnan(near)] = np.inf
        a, b = np.nonzero(near >= (np.partition(near, -k, axis=1)[:, -k, None] - ROUNDING)) if len(v) > k else \
            tuple(x.ravel() for x in np.indices(near.shape))
        score = np.zeros(len(a))
        for d in range(v.shape[1]):
            score += v[b, d] * part[a, d]
        order = np.lexsort((b, np.where(np.isnan(score), -np.inf, -score), a))
        order = order[_first_of_key(a[order], k)]
        found.append((a[order] + low, rows[b[order]], score[order]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        qi, vi, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if v.num_rows and q.num_rows:
            v = v.sort_by("id") if not v["id"].null_count else pa.concat_tables(
                [v.filter(v["id"].is_null()), v.filter(v["id"].is_valid()).sort_by("id")])
            vectors, asked = _matrices(v["_v"]), _matrices(q["_q"])
            none = np.arange(q.num_rows)
            for n, (at, m) in asked.items():
                if n in vectors:
                    rows, x = vectors[n]
                    a, b, s = _top(m, x, k)
                    qi, vi, scores = qi + [at[a]], vi + [rows[b]], scores + [s]
                    # Vectors without a score come after those with one, by id.
                    rest = np.setdiff1d(np.arange(v.num_rows), rows)[:max(0, k - len(rows))]
                    qi, vi = qi + [np.repeat(at, len(rest))], vi + [np.tile(rest, len(at))]
                    scores.append(np.full(len(at) * len(rest), -np.inf))
                    none = np.setdiff1d(none, at)
            first = min(k, v.num_rows)
            qi, vi = qi + [np.repeat(none, first)], vi + [np.tile(np.arange(first), len(none))]
            scores.append(np.full(len(none) * first, -np.inf))
        score = np.concatenate(scores)
        got = v.select(["id", "metadata"]).take(pa.array(np.concatenate(vi)))
        return (got.append_column("question_id", q["question_id"].take(pa.array(np.concatenate(qi))))
                .append_column("score", pa.array(score, pa.float64(), mask=np.isneginf(score), from_pandas=False)))
    return run


def best_in_blocks(v: DataFrame, questions: DataFrame, block: Sequence[str], k: int) -> DataFrame:
    """(id, metadata, question_id, score): of the vectors (id, metadata, _v) of a block the ``k`` best, by score
    and id, for each of its questions (question_id, _q). A block's vectors and questions meet in one task;
    the caller bounds their number."""
    ship_package(v.sparkSession)
    fields = [v.schema["id"], v.schema["metadata"], questions.schema["question_id"], T.StructField("score", T.DoubleType())]
    left = v.select("id", "metadata", "_v", *block).groupBy(*block)
    return left.cogroup(questions.select("question_id", "_q", *block).groupBy(*block)).applyInArrow(
        _best(k), T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def similar_sessions(v: DataFrame, questions: DataFrame, k: int = SIMILAR_TOP_K,
                     start: int | None = None, per_user: bool = False) -> DataFrame:
    """K3: top-``k`` vectors by cosine per question (ties by id), after the metadata
    filter ``timestamp >= start``. ``questions``: (question_id, query_vec[, user_id]).

    ``per_user=True`` matches each question with the vectors of its ``user_id`` only
    (equi-join); otherwise questions and vectors are dealt into blocks by hash, every block of the one
    meets every block of the other in a group of its own, and a group gives ``k`` rows a question. What is
    shuffled is a vector for each block of questions and a question for each block of vectors, not the
    pairs. Vectors and questions are normalised once, so a score is one dot product.
    """
    vv = v if start is None else v.filter(F.col("metadata.timestamp") >= F.lit(start))
    vv = vv.select("id", "metadata", _unit(F.col("values")).alias("_v"))
    qs = questions.withColumn("_q", _unit(F.col("query_vec")))
    if per_user:
        x = vv.join(qs.select("question_id", "user_id", "_q"), vv["metadata.user_id"] == qs["user_id"], "inner")
        x = x.withColumn("score", _dot(F.col("_v"), F.col("_q")))
        extra = ["question_id", "user_id"]
    else:
        across, down = question_blocks(questions), max(1, -(-vv.select("id").count() // VECTOR_BLOCK))
        vv = vv.withColumn("_r", F.pmod(F.xxhash64("id", "metadata", "_v"), F.lit(down)).cast("int"))
        vv = vv.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        qs = qs.select("question_id", "_q", question_block(across).alias("_b"),
                       F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_r"))
        x = best_in_blocks(vv, qs, ["_r", "_b"], k)
        extra = ["question_id"]
    x = top_n(x, k, [F.col("score").desc(), F.col("id")], ["question_id"], rank_col="rank")
    return _flatten_match(x, extra + ["rank"])


# ---------------------------------------------------------------------------
# Reflection contexts
# ---------------------------------------------------------------------------

def context_rows(s: DataFrame, c: DataFrame, start: int | None,
                 limit: int | None = None, keys=KEYS) -> DataFrame:
    """All sessions since ``start`` (with ``limit`` only the newest per key), with category."""
    x = s if start is None else s.filter(F.col("timestamp") >= F.lit(start))
    if limit is not None:
        x = top_n(x, limit, [F.col("timestamp").desc(), F.col("id").desc()], keys)
    return with_category(x, c, ("name", "wellness_type"))


def context_stats(rows: DataFrame, sites: int = CONTEXT_SITES_PER_CATEGORY,
                  keys=KEYS) -> DataFrame:
    """Per key and category: count, total, rounded minutes, place by newest row, and the
    site lines of its ``sites`` newest rows."""
    by = [*keys, "category_name"]
    newest = [F.col("timestamp").desc(), F.col("id").desc()]
    site_line = F.concat(F.lit(const.CONTEXT_SITE),
                         F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")),
                         F.lit(" ("), minutes_rounded(F.col("duration")).cast("string"),
                         F.lit("m)\n"))
    listed = (top_n(rows, sites, newest, by, rank_col="_site_rank").groupBy(*by)
              .agg(F.sort_array(F.collect_list(F.struct("_site_rank", "timestamp", "id", site_line.alias("l")))).alias("_sites")))
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("session_count"), F.sum("duration").alias("total_time"))
    first = F.col("_sites")[0]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(first["timestamp"].desc(), first["id"].desc()))
    return totals.join(listed, by).select(
        *keys, F.col("category_name").alias("category"), "session_count", "total_time",
        minutes_rounded(F.col("total_time")).alias("minutes"), place.cast("long").alias("first_pos"),
        F.array_join(F.transform("_sites", lambda e: e["l"]), "").alias("sites_text"))


def _category_block(stats: DataFrame, keys=KEYS) -> DataFrame:
    block = F.concat(F.lit("- "), F.col("category"), F.lit(": "),
                     F.col("minutes").cast("string"), F.lit(" minutes ("),
                     F.col("session_count").cast("string"), F.lit(" sessions)\n"),
                     F.when(F.col("sites_text") != "",
                            F.concat(F.lit(const.CONTEXT_TOP_SITES), F.col("sites_text")))
                     .otherwise(F.lit("")))
    return stats.groupBy(*keys).agg(
        F.sum("session_count").alias("total_sessions"),
        F.array_join(F.transform(F.sort_array(F.collect_list(
            F.struct("first_pos", block.alias("b")))), lambda e: e["b"]), "").alias("_blocks"))


def _relevant_block(matches: DataFrame, keys=KEYS) -> DataFrame:
    t = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"))
    when_txt = F.when(_truthy(F.col("timestamp"), numeric=True), iso_ts(F.col("timestamp"))) \
        .otherwise(F.lit(const.CONTEXT_NO_TIME))
    line = F.concat(F.lit("- "), F.col("rank").cast("string"), F.lit(". "), t, F.lit(" ("),
                    minutes_rounded(F.coalesce(F.col("duration"), F.lit(0))).cast("string"),
                    F.lit("m, "), when_txt, F.lit(")\n  "), F.col("url"), F.lit("\n"))
    return matches.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("rank", line.alias("l")))), lambda e: e["l"]), "").alias("_relevant"))


def reflection_context(users: DataFrame, stats: DataFrame, matches: DataFrame | None = None,
                       keys=KEYS) -> DataFrame:
    """The context text per key; keys without rows get the no-activity text."""
    b = _category_block(stats, keys)
    x = users.select(*keys).distinct().join(b, list(keys), "left")
    body = F.concat(F.lit(const.CONTEXT_TOTAL), F.col("total_sessions").cast("string"),
                    F.lit(const.CONTEXT_BY_CATEGORY), F.col("_blocks"))
    if matches is not None:
        x = x.join(_relevant_block(matches, keys), list(keys), "left")
        body = F.concat(body, F.when(F.col("_relevant").isNotNull(), F.concat(
            F.lit(const.CONTEXT_RELEVANT), F.col("_relevant")))
            .otherwise(F.lit("")))
    text = F.when(F.col("total_sessions").isNull(), F.lit(NO_ACTIVITY_CONTEXT)).otherwise(body)
    return x.select(*keys, F.coalesce(F.col("total_sessions"), F.lit(0)).alias("total_sessions"),
                    text.alias("context"))


def reflection_history(r: DataFrame, limit: int = REFLECTION_HISTORY_LIMIT, keys=KEYS) -> DataFrame:
    """L4: newest ``limit`` reflections per key (id, query, response, timestamp)."""
    x = top_n(r, limit, [F.col("timestamp").desc(), F.col("id").desc()], keys)
    return x.select("id", *keys, "query", "response", "timestamp")


def reflection_by_id(r: DataFrame, reflection_id: int) -> DataFrame:
    """One reflection (empty when absent)."""
    return r.filter(F.col("id") == F.lit(reflection_id))


def vector_orphans(v: DataFrame, s: DataFrame) -> DataFrame:
    """K4: vectors whose session is gone, and sessions without a vector. Reads the ids only: one
    full outer join."""
    both = v.select(F.col("id").cast("string").alias("vid")).join(
        s.select(F.col("id").cast("string").alias("sid")), F.col("vid") == F.col("sid"), "full_outer")
    return both.filter(F.col("vid").isNull() | F.col("sid").isNull()).select(
        F.when(F.col("sid").isNull(), F.lit("orphan_vector")).otherwise(F.lit("missing_vector")).alias("kind"),
        F.coalesce("vid", "sid").alias("id"))


# ---------------------------------------------------------------------------
# Insight cache plan
# ---------------------------------------------------------------------------

def insight_cache_plan(s: DataFrame, c: DataFrame, cache: DataFrame, first_day: str,
                       last_day: str, refresh: bool = False, tz_day: Column | None = None,
                       keys=KEYS) -> DataFrame:
    """Per key and day in [first_day, last_day]: 'cached' when a cached insight exists
    (and no refresh), 'no_activity' when the day has no sessions, else 'generate', with
    the metadata the insight would carry (total time text, rows, top category)."""
    from tabtrail.functions.time import day_string
    day = tz_day if tz_day is not None else day_string(F.col("timestamp"))
    sj = with_category(s, c, ("name",)).withColumn("date", day)
    per_cat = sj.groupBy(*keys, "date", "category_name").agg(F.sum("duration").alias("t"),
                                                            F.count(F.lit(1)).alias("n"))
    meta = per_cat.groupBy(*keys, "date").agg(
        F.sum("t").alias("total_time"), F.sum("n").alias("session_count"),
        F.sort_array(F.collect_list(F.struct(-F.col("t"), F.col("category_name"))))[0]
        ["category_name"].alias("top_category"))
    days = s.select(*keys).distinct().select(*keys, F.explode(F.sequence(
        F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day)))).alias("_d"))
    days = days.select(*keys, F.date_format("_d", "yyyy-MM-dd").alias("date"))
    x = days.join(meta, [*keys, "date"], "left").join(
        cache.select(*keys, "date", F.lit(True).alias("_cached")), [*keys, "date"], "left")
    action = (F.when(F.lit(not refresh) & F.col("_cached").isNotNull(), F.lit("cached"))
              .when(F.col("session_count").isNull(), F.lit("no_activity"))
              .otherwise(F.lit("generate")))
    return x.select(*keys, "date", action.alias("action"),
                    format_hm(F.col("total_time")).alias("total_text"),
                    "session_count", "top_category")


# ---------------------------------------------------------------------------
# Optional text generation on the contexts (pluggable; default: none)
# ---------------------------------------------------------------------------

ANSWER_SCHEMA = T.StructType([T.StructField("user_id", T.LongType()),
                              T.StructField("question_id", T.LongType()),
                              T.StructField("answer", T.StringType())])


def generate_answers(contexts: DataFrame, questions: DataFrame, generator=None) -> DataFrame:
    """Answer each question with its user's context. ``generator`` is a pandas function
    ``(query: pd.Series, context: pd.Series) -> pd.Series`` run by ``mapInPandas``; a
    failing row yields a null answer. Without a generator the context is the answer."""
    import pandas as pd
    x = questions.select("user_id", "question_id", "query").join(
        contexts.select("user_id", "context"), "user_id", "left")
    if generator is None:
        return x.select("user_id", "question_id", F.col("context").alias("answer"))

    ship_package(questions.sparkSession)

    def run(batches):
        for pdf in batches:
            answers = row_by_row(lambda part: generator(part["query"], part["context"]), pdf)
            yield pd.DataFrame({"user_id": pdf["user_id"], "question_id": pdf["question_id"],
                                "answer": pd.Series([None if a is FAILED else a for a in answers],
                                                    index=pdf.index, dtype=object)})
    return x.mapInPandas(run, ANSWER_SCHEMA)


CONTEXT_JSON_SCHEMA = "total_sessions BIGINT, context STRING"


def parse_context(col: Column, schema: str = CONTEXT_JSON_SCHEMA) -> Column:
    """F13 decode: the JSON context stored with a reflection back into a struct."""
    return F.from_json(col, schema)
