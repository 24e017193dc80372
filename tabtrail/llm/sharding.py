"""Operator 5: sharding by jump consistent hash, in DataFrame functions only.

The law is ``key``: the stable key and the number of shards decide alone. The jump hash
(Lamping and Veach 2014) follows a pseudo-random chain of ever larger shard numbers and takes
the last one below the shard count, so no ring table exists and one more shard takes rows only
into itself. One pass along the chain gives the shard for ``n`` and for ``n + 1``. The 64-bit
step is done in decimal(38), which holds the product exactly under any overflow setting.

Slots number the rows of a shard without gaps and without one task per shard: equal
(key, size, checksum) rows are counted first (combined on the map side) and go on in pieces of ``PIECE`` rows,
each shard is cut into blocks by a hash of key, size, checksum and piece, so that neither evenly spaced
keys nor a row that is a third of the table crowd a block, running counts are taken inside a block, and block
offsets are added. Blocks are ``SLOT_BLOCKS`` a shard, or as many (a power of two) as hold ``BLOCK_ROWS`` rows
each on average, and so is the table of offsets.

Defined results: a null key hashes as 0; a null text has size 1 and checksum 0; rows equal in
key, size and checksum take consecutive slots; an empty table gives an empty result. Only the key
and text columns are read by ``shard_slots``; ``with_shard`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS = 16
SLOT_BLOCKS = 1024
BLOCK_ROWS = 1 << 16
PIECE = 4096
#: Fixed values of the published algorithm: multiplier of the 64-bit step, modulus, and the
#: numerator of the jump.
STEP = 2862933555777941757
MODULUS = 1 << 64
HIGH = 1 << 33
JUMP = float(1 << 31)


def _dec(n) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard) of a bigint key, for ``shards`` and ``shards + 1``."""
    if shards < 1:
        raise ValueError("at least one shard")
    k = F.coalesce(key, F.lit(0)).cast("decimal(20,0)")
    start = F.struct(F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("grown"),
                     F.lit(0).cast("bigint").alias("j"), F.when(k < 0, k + _dec(MODULUS)).otherwise(k).cast("decimal(20,0)").alias("key"))

    def step(a: Column, _i: Column) -> Column:
        key = ((a["key"] * _dec(STEP) + F.lit(1)) % _dec(MODULUS)).cast("decimal(20,0)")
        high = F.floor(key / _dec(HIGH)).cast("bigint")
        j = F.floor((a["j"] + 1) * (F.lit(JUMP) / (high + 1).cast("double"))).cast("bigint")
        moved = F.struct(F.when(a["j"] < shards, a["j"]).otherwise(a["shard"]).alias("shard"),
                         a["j"].alias("grown"), j.alias("j"), key.alias("key"))
        return F.when(a["j"] <= shards, moved).otherwise(a)

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.transform(F.array(walked), lambda a: F.struct(
        a["shard"].cast("int").alias("shard"), a["grown"].cast("int").alias("grown_shard")))[0]


def with_shard(df: DataFrame, key: Column, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """``df`` plus its shard number; no row moves. Keys that are not bigint are hashed with
    xxhash64 first."""
    k = key if dict(df.select(key.alias("k")).dtypes)["k"] in ("bigint", "int") else F.xxhash64(key)
    return df.withColumn(name, jump_shards(k.cast("bigint"), shards)["shard"])


def shard_slots(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                shards: int = SHARDS, blocks: int | None = None) -> DataFrame:
    """One row per document row: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("crc"))
    if blocks is None:
        blocks = max(SLOT_BLOCKS, 1 << (max(1, rows.count() // (shards * BLOCK_ROWS)) - 1).bit_length())
    same = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n"))
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / PIECE)))
    pieces = same.select("id", "size", "crc", piece.alias("piece"), "n").withColumn(
        "n", F.least(F.col("n") - F.col("piece") * PIECE, F.lit(PIECE).cast("bigint")))
    name = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), "size", "crc", "piece")
    block = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint") % blocks
    placed = (pieces.withColumn("s", jump_shards(F.col("id").cast("bigint"), shards))
              .select("id", "size", "crc", "piece", "n", "s.shard", "s.grown_shard", block.alias("block")))
    totals = placed.groupBy("shard", "block").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("shard", "block").orderBy("id", "size", "crc", "piece")
              .rowsBetween(Window.unboundedPreceding, -1))
    ranked = placed.withColumn("prior", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    first = F.col("offset") + F.col("prior")
    return (ranked.join(offsets, ["shard", "block"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"),
                    "shard", "grown_shard", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot")))
