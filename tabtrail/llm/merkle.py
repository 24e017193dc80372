"""Operator 12: Merkle dataset manifest with proofs by a recursive climb.

Leaves are hashes of rows. The leaves of one group, in order, make a tree of ``WIDTH`` children a
node, whose top is the group's subroot; the subroots, in order of the groups, make a tree whose
top is the root. A built level is stored as rows that name their parent (``Manifest.nodes``). Proofs
come from one ``WITH RECURSIVE`` query: it starts at the leaves, and each step joins the parent's row,
appends the siblings met there and folds every leaf's present hash (the changed one, else the leaf's own) with
them, until the root. Nothing is taken as verified unseen: a leaf is verified if its own fold ends at the root.

Decisions for scale:

* A text is hashed where it is read; only keys and hashes (32 bytes each) move. The leaf hashes are
  written once, so that sorting does not read texts again.
* Leaves are numbered by a range sort: a position inside (partition, group) counted along the sorted
  partition, plus what earlier partitions hold of the partition's first group. That table has one
  row a partition, the bound of its broadcast. A group may span any number of partitions. Row
  numbers from the leaf table break ties, so equal rows can be split as well.
* The (at most ``WIDTH``) leaves below one node share their path, so they climb as one row that holds the
  path's siblings once and a folded hash (32 bytes) for each leaf, in their order; the first level's siblings,
  which differ from leaf to leaf, are cut out when the proofs are given.
* High nodes are met by many climbers. A node over more than ``SPREAD`` leaves is stored in one copy for
  every ``SPREAD`` leaves, and climbers are dealt over the copies: no join key is hot, and the
  copies of a level number leaves / SPREAD, whatever its height.

The driver sees the largest group's size and the number of groups, which set the number of levels.
Leaves, levels and groups are written below the checkpoint folder.

Defined results: any column may be null; a null or empty group value is a group of its own; a lone leaf is its
group's subroot, a lone subroot is the root; rows equal in group and key are ordered by leaf hash, so
repeated rows are leaves of their own; long texts are hashed whole; an empty table has no
leaves. Columns are named by the caller; others, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabtrail.llm.common import prepare
from tabtrail.session import checkpoint_dir

WIDTH = 16
SPREAD = 4096


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts, lower-case hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """One value of a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


@dataclass
class Manifest:
    """A built manifest. ``nodes``: one row a (node, copy) with id, copy, hash, children, parent, place and
    parent_copies; ``starts``: one row a lowest node with its leaves."""

    nodes: DataFrame
    starts: DataFrame
    root: str | None


def _numbered(df: DataFrame, order: list[str], group: str) -> DataFrame:
    """``df`` sorted by ``order`` over range partitions, with ``pid`` and ``k``, the position among the rows of
    its group in its partition. ``group`` is a string column that leads the order."""
    keys = [F.asc_nulls_first(c) for c in order]
    names = df.columns
    at = names.index(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, seen = object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(at))
            ends, values = np.asarray(runs.run_ends), runs.values.to_pylist()
            k = np.arange(b.num_rows, dtype=np.int64)
            low = 0
            for value, end in zip(values, ends.tolist()):
                seen = seen if value == last else 0
                k[low:end] += seen - low
                seen, last, low = seen + end - low, value, end
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(k)], names=[*names, "pid", "k"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(count, f"{schema}, pid int, k bigint")


def _carried(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``idx``, their position in the whole group; one row a group with its size n)."""
    pieces = rows.groupBy("pid", group).agg(F.count("*").alias("c"))
    # A group over several partitions is the last one of its first partition and the first one of the
    # others, so what partitions must know of each other lies in their first and last pieces.
    ends = rows.groupBy("pid").agg(F.min(F.struct(group)).alias("low"), F.max(F.struct(group)).alias("high"))
    ends = ends.select(F.col("pid").alias("at"), F.explode(F.array_distinct(F.array("low", "high"))).alias("of"))
    edge = (pieces.join(ends, (F.col("pid") == F.col("at")) & F.col(group).eqNullSafe(F.col(f"of.{group}")))
            .select("pid", group, "c"))
    before = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = (edge.withColumn("off", F.coalesce(F.sum("c").over(before), F.lit(0)))
               .where("off > 0").select(F.col("pid").alias("at"), F.col(group).alias("of"), "off"))
    joined = rows.join(F.broadcast(carried), (F.col("pid") == F.col("at")) & F.col(group).eqNullSafe(F.col("of")), "left")
    idx = (F.col("k") + F.coalesce("off", F.lit(0))).cast("bigint")
    return (joined.withColumn("idx", idx).drop("at", "of", "off", "pid", "k"),
            pieces.groupBy(group).agg(F.sum("c").cast("bigint").alias("n")))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves: the least h with WIDTH^h >= n."""
    h = F.lit(0)
    for k in range(1, 16):
        h = F.when(n > F.lit(WIDTH ** (k - 1)), F.lit(k)).otherwise(h)
    return h


def _up(level: DataFrame, at: int) -> DataFrame:
    """The next level from rows (g, n, idx, hash, weight): one row a run of WIDTH consecutive nodes."""
    run = F.floor(F.col("idx") / WIDTH).cast("bigint").alias("up")
    return (level.groupBy("g", "n", run)
            .agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("c"), F.sum("weight").alias("weight"))
            .select("g", "n", F.col("up").alias("idx"), "weight", F.lit(at).alias("lvl"),
                    F.col("c.hash").alias("children"))
            .withColumn("hash", digest(F.array_join("children", ""))))


def _grown(spark: SparkSession, level: DataFrame, most: int, folder: str, start: int) -> None:
    """Write the levels ``start``+1.. above ``level`` (rows g, n, idx, hash, weight), each from the one below;
    a tree whose level is one node is done."""
    lvl = start
    while WIDTH ** lvl < most:
        lvl += 1
        _up(level, lvl).write.parquet(f"{folder}/lvl={lvl}")
        done = height(F.col("n"))
        level = spark.read.parquet(f"{folder}/lvl={lvl}").where(done > lvl)


def _node_id(g: Column, lvl, idx: Column) -> Column:
    return F.struct(g.cast("bigint").alias("g"), F.lit(lvl).cast("int").alias("lvl") if isinstance(lvl, int) else lvl.cast("int").alias("lvl"),
                    idx.cast("bigint").alias("idx"))


def build(rows: DataFrame) -> Manifest:
    """A manifest of ``rows`` (grp string, key bigint, leaf, changed): ``leaf`` is the hex hash of the row,
    ``changed`` that of its altered form or null. Leaves are ordered by key, groups by value in bytes."""
    spark = prepare(rows.sparkSession)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    path = lambda name: f"{folder}/{name}"
    read = lambda name: spark.read.parquet(path(name))
    (rows.select("grp", "key", F.unhex("leaf").alias("leaf"), F.unhex("changed").alias("changed"))
     .withColumn("row", F.monotonically_increasing_id()).write.parquet(path("leaves")))
    _numbered(read("leaves"), ["grp", "key", "leaf", "row"], "grp").drop("row").write.parquet(path("sorted"))
    leaves, groups = _carried(read("sorted"), "grp")
    groups.write.parquet(path("sizes"))
    ranked, one = _carried(_numbered(read("sizes").select(F.lit("").alias("all"), "grp", "n"), ["all", "grp"], "all"), "all")
    ranked.select("grp", "n", F.col("idx").alias("g")).write.parquet(path("groups"))
    found = read("groups").agg(F.max("n").alias("most"), F.count("*").alias("groups")).first()
    if not found["groups"]:
        return Manifest(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], START_SCHEMA), None)

    # Lowest runs: a row for each WIDTH leaves, before their group's number is joined, so that the
    # join moves rows of runs.
    runs = (leaves.groupBy("grp", F.floor(F.col("idx") / WIDTH).cast("bigint").alias("idx"))
            .agg(F.array_sort(F.collect_list(F.struct(F.pmod("idx", F.lit(WIDTH)).cast("int").alias("place"), "key",
                                                      F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("changed")).alias("changed")))).alias("leaves")))
    named = runs.join(read("groups").withColumnRenamed("grp", "name"), F.col("grp").eqNullSafe(F.col("name"))).drop("grp", "name")
    lone = F.col("n") == 1
    (named.withColumn("children", F.col("leaves.leaf")).withColumn("lvl", F.when(lone, 0).otherwise(1))
     .withColumn("hash", F.when(lone, F.element_at("children", 1)).otherwise(digest(F.array_join("children", ""))))
     .withColumn("weight", F.size("leaves").cast("bigint")).write.parquet(path("starts")))
    starts = read("starts")

    _grown(spark, starts.where(height(F.col("n")) > 1).select("g", "n", "idx", "hash", "weight"), found["most"], path("own"), 1)
    cols = ["g", "n", "lvl", "idx", "hash", "children", "weight"]
    own = starts.select(*cols)
    if found["most"] > WIDTH:
        own = own.unionByName(read("own").select(*cols))
    own = own.withColumn("lvl", F.col("lvl").cast("int"))
    tops = own.where(F.col("lvl") == height(F.col("n")))
    (tops.select(F.lit(-1).cast("bigint").alias("g"), F.lit(found["groups"]).cast("bigint").alias("n"), F.col("g").alias("idx"), "hash", "weight")
     .write.parquet(path("tops")))
    every = own
    if found["groups"] > 1:
        _grown(spark, read("tops"), found["groups"], path("over"), 0)
        every = own.unionByName(read("over").select(*cols).withColumn("lvl", F.col("lvl").cast("int")))
    _linked(every, found["groups"]).write.parquet(path("nodes"))
    top = read("over") if found["groups"] > 1 else read("tops")
    last = top.where(F.col("lvl") == height(F.col("n"))) if found["groups"] > 1 else top
    return Manifest(read("nodes"), starts, last.first()["hash"])


NODE_SCHEMA = ("id struct<g:bigint,lvl:int,idx:bigint>, copy bigint, hash string, children array<string>, subroot boolean, "
               "parent struct<g:bigint,lvl:int,idx:bigint>, place int, copies bigint")
START_SCHEMA = ("idx bigint, leaves array<struct<place:int,key:bigint,leaf:string,changed:string>>, n bigint, g bigint, "
                "children array<string>, lvl int, hash string, weight bigint")


def _copies(weight: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(weight / SPREAD)).cast("bigint")


def _linked(nodes: DataFrame, groups: int) -> DataFrame:
    """Node rows with the id of the parent and the place among its children, in as many copies as the climbers
    need. The number of the parent's copies is joined by the parent's id."""
    is_top = (F.col("lvl") == height(F.col("n")))
    own = F.col("g") >= 0
    inside = ~is_top
    link = F.when(inside, _node_id(F.col("g"), F.col("lvl") + 1, F.floor(F.col("idx") / WIDTH)))
    place = F.when(inside, F.pmod("idx", F.lit(WIDTH)))
    if groups > 1:
        link = F.when(own & is_top, _node_id(F.lit(-1), 1, F.floor(F.col("g") / WIDTH))).otherwise(link)
        place = F.when(own & is_top, F.pmod("g", F.lit(WIDTH))).otherwise(place)
    rows = nodes.select(_node_id(F.col("g"), F.col("lvl"), F.col("idx")).alias("id"), "hash", "children", "weight",
                        (own & is_top).alias("subroot"), link.alias("parent"), place.cast("int").alias("place"))
    above = rows.where(_copies(F.col("weight")) > 1).select(F.col("id").alias("up"), _copies(F.col("weight")).alias("up_copies"))
    joined = rows.join(above, F.col("parent") == F.col("up"), "left")
    return joined.select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), _copies(F.col("weight")) - 1)).alias("copy"),
                         "hash", "children", "subroot", "parent", "place", F.coalesce("up_copies", F.lit(1).cast("bigint")).alias("copies"))


#: One row a lowest node: its start, where it stands, the siblings met so far (bytes) and the folded
#: hash (bytes) of each of its leaves. A step joins the parent's copy that the start is dealt to.
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT start, parent, place, copies, subroot, tail, folded FROM {starts}
  UNION ALL
  SELECT c.start, n.parent, n.place, n.copies, coalesce(c.subroot, CASE WHEN n.subroot THEN n.hash END),
         concat(c.tail, unhex(array_join(filter(n.children, (h, i) -> i <> c.place), ''))),
         transform(c.folded, f -> unhex(sha2(cast(array_join(
           transform(n.children, (h, i) -> if(i = c.place, lower(hex(f)), h)), '') AS binary), 256)))
  FROM climb c JOIN {nodes} n
    ON n.id = c.parent AND n.copy = pmod(xxhash64(c.start), c.copies)
)
SELECT start, subroot, tail, folded FROM climb WHERE parent IS NULL LIMIT ALL
"""


def _replaced(children: Column, place: Column, value: Column) -> Column:
    return F.transform(children, lambda h, i: F.when(i == place, value).otherwise(h))


def _present(leaf: Column) -> Column:
    """The hash of a leaf's row as it is now."""
    return F.coalesce(leaf["changed"], leaf["leaf"])


def prove(manifest: Manifest) -> DataFrame:
    """One row a leaf: key, leaf, subroot, root, proof_sha256 (of all siblings, level by level), folded_root and
    verified, from a climb of every leaf to the root; the present hash of every leaf, changed or not, is folded."""
    spark = manifest.nodes.sparkSession
    start = _node_id(F.col("g"), F.col("lvl"), F.col("idx"))
    links = manifest.nodes.where("copy = 0").select("id", "parent", "place", "copies", "subroot")
    rows = manifest.starts.withColumn("start", start)
    # The leaves of a run are its first places without a gap, so a leaf's place is its index.
    first = F.transform("leaves", lambda x: F.unhex(F.when(F.col("lvl") == 0, _present(x)).otherwise(
        digest(F.array_join(_replaced(F.col("children"), x["place"], _present(x)), "")))))
    begun = (rows.select("start", "hash", first.alias("folded")).join(links, F.col("start") == F.col("id"))
             .select("start", "parent", "place", "copies", F.when(F.col("subroot"), F.col("hash")).alias("subroot"),
                     F.lit(b"").alias("tail"), "folded"))
    climbed = spark.sql(CLIMB, starts=begun, nodes=manifest.nodes)
    told = (rows.join(climbed, "start")
            .select(F.explode("leaves").alias("l"), "children", "subroot", "tail", "folded"))
    siblings = F.array_join(F.filter("children", lambda h, i: i != F.col("l.place")), "")
    folded = F.lower(F.hex(F.get("folded", F.col("l.place"))))
    root = F.lit(manifest.root)
    return (told.select(F.col("l.key").alias("key"), F.col("l.leaf").alias("leaf"), "subroot", root.alias("root"),
                        digest(siblings, F.lower(F.hex("tail"))).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
