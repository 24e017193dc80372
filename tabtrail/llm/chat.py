"""Operator 1: chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

A logger that saves a conversation after every turn leaves snapshots, each a prefix of the
next. The rolling hash of a turn prefix is the sum, lane by lane, of the turns' hashes, each
salted with its position, so prefix hashes are running sums. A conversation whose full hash
is a proper prefix hash of another is a snapshot of it; anti-joins on the hash retain the
maximal conversations, and equal ones are collapsed to the one with the smallest id. What is
retained is rendered. Turns and prefixes count as equal by 128-bit hashes, which are not verified against
the texts.

Long conversations: first only turn numbers and content hashes move. Distinct turns are dealt to tasks by ranges
of (conversation, turn, hash), which Spark cuts by a sample into equal parts, so a null or hot conversation lies in as many
parts as it needs. Turns are numbered and hashed inside a part, and what a conversation's earlier parts hold is
added from a second, much smaller window. Prefix hashes are distinct before the join and full hashes grouped
(both combined on the map side), so a first turn or a conversation that is logged very often is one row there, as is a
turn that is repeated very often. Then the texts of retained conversations are joined to the numbered turns and
rendered, ``block`` turns to a row: part k holds the turns k * block + 1 to (k + 1) * block, whatever the
conversation's size. A row is bounded in turns, not in bytes.

Order and equality: turns are ordered by turn number, ties by the md5 of role and text; rows equal
in all four columns are one turn, logged twice. A null turn comes first, a null role is rendered as
``unknown`` and differs from every role, a null text is rendered empty and differs from it. Rows
with a null conversation id are one conversation with that id. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 256
LANES = 4
#: Ranges for each shuffle partition: more and smaller ranges even out over the tasks they are hashed to.
RANGES = 4
#: Fixed values of the rendered form.
TURN_HEAD, TURN_TAIL = "<|im_start|>", "<|im_end|>\n"


def _content_hash() -> Column:
    marked = [F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-")) for c in ("role", "text")]
    return F.md5(F.concat_ws(":", *[F.length(m).cast("string") for m in marked], *marked))


def _lanes(pos: Column, content: Column) -> list[Column]:
    """128 bits of a turn and its position, in lanes of 32 bits: sums of fewer than 2^31
    turns fit a bigint."""
    h = F.md5(F.concat_ws(":", pos.cast("string"), content))
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(LANES)]


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return rows.withColumn("h", _content_hash())


def numbered_turns(rows: DataFrame) -> DataFrame:
    """The distinct turns of (conv, turn, h): key (struct of conversation and range, never null, so that null ids
    join), turn, h, pos (from 1) and all_n, the conversation's number of turns."""
    order = [F.asc_nulls_first("turn"), F.asc("h")]
    n = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("conv", F.spark_partition_id().alias("range")).alias("key")
    dealt = (rows.select("conv", "turn", "h").distinct().repartitionByRange(n, F.asc_nulls_first("conv"), *order)
             .select(key, "turn", "h").checkpoint())
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n"))
    inside = dealt.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return _with_past(inside, sizes, ["n"]).select("key", "turn", "h", (F.col("past_n") + F.col("i")).alias("pos"), "all_n")


def _with_past(df: DataFrame, totals: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` (by key) with ``past_<col>`` and ``all_<col>``: sums of ``cols`` over the conversation's
    earlier blocks and over all of them."""
    whole = Window.partitionBy(F.struct(F.col("key.conv").alias("conv")))
    order = [F.col(f"key.{c}") for c in totals.schema["key"].dataType.names if c != "conv"]
    before = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    past = totals.select("key", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias("past_" + c) for c in cols],
                         *[F.sum(c).over(whole).alias("all_" + c) for c in cols])
    return df.join(past, "key")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """One row per numbered turn: conv, pos (from 1), prefix (hash of the conversation up to it) and whether
    the turn is the last."""
    lanes = [f"l{i}" for i in range(LANES)]
    hashed = placed.select("key", "pos", "all_n", *[x.alias(n) for n, x in zip(lanes, _lanes(F.col("pos"), F.col("h")))])
    upto = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select("key", "pos", "all_n", *[F.sum(x).over(upto).alias(x) for x in lanes])
    totals = hashed.groupBy("key").agg(*[F.sum(x).alias(x) for x in lanes])
    prefix = F.md5(F.concat_ws(":", "pos", *[F.col(x) + F.col("past_" + x) for x in lanes]))
    return _with_past(summed, totals, lanes).select(
        F.col("key.conv").alias("conv"), "pos", prefix.alias("prefix"), (F.col("pos") == F.col("all_n")).alias("last"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """Conversations that no longer one starts with, equal ones once: conv, n_turns, n_copies."""
    equal = (prefixes.where("last").groupBy(F.col("prefix").alias("full"), F.col("pos").alias("n_turns"))
             .agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies")))
    inner = prefixes.where("NOT last").select("prefix").distinct()
    return equal.join(inner, equal.full == inner.prefix, "left_anti").select("conv", "n_turns", "n_copies")


def render_turn() -> Column:
    return F.concat(F.lit(TURN_HEAD), F.coalesce("role", F.lit("unknown")), F.lit("\n"),
                    F.coalesce("text", F.lit("")), F.lit(TURN_TAIL))


def format_chats(turns: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text",
                 block: int = BLOCK) -> DataFrame:
    """Retained conversations, rendered: conv_id, part (from 0; texts of a conversation's parts
    follow one another), first_turn, n_turns and n_copies of the whole, text of the part (``block`` turns, the
    last part fewer)."""
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    placed = numbered_turns(rows).checkpoint()
    kept = maximal(prefix_hashes(placed)).withColumnRenamed("conv", "c").checkpoint()
    wanted = F.struct("conv") == F.struct(F.col("c").alias("conv"))
    one = F.struct("conv", "turn", "h").alias("id")
    texts = rows.join(kept.select("c"), wanted, "left_semi").groupBy(one).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    part = F.floor((F.col("pos") - 1) / block).cast("bigint")
    at = (placed.withColumn("conv", F.col("key.conv")).join(kept, wanted)
          .select(one, "conv", "pos", part.alias("part"), F.col("n_turns").cast("bigint").alias("n_turns"), "n_copies"))
    said = at.join(texts, "id").select("conv", "part", "n_turns", "n_copies", F.struct("pos", render_turn().alias("said")).alias("t"))
    return (said.groupBy("conv", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("t")).alias("ts"))
            .select(F.col("conv").alias("conv_id"), "part", (F.col("part") * block + 1).alias("first_turn"), "n_turns", "n_copies",
                    F.array_join(F.col("ts.said"), "").alias("text")))
