"""Operator 12 against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabtrail.llm import merkle, queries_manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(hashes, width):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + width])) for i in range(0, len(out[-1]), width)])
    return out


def climb(tree, i, h, width):
    """(siblings, folded hash) from leaf i of a tree's levels."""
    met = ""
    for level in tree[:-1]:
        low = i - i % width
        run = level[low:low + width]
        met += "".join(x for j, x in enumerate(run) if j != i - low)
        run[i - low] = h
        h, i = sha("".join(run)), i // width
    return met, h


def plain(docs, width):
    """docs: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for doc_id, source, lang, n, text in docs:
        head = "".join(map(field, (doc_id, source, lang, n)))
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaf = sha(head + field(text))
        groups.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, sha(head + field(low)) if chosen else leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[0])], width) for s in names}
    top = levels([trees[s][-1][0] for s in names], width)
    root, out = top[-1][0], []
    for g, s in enumerate(names):
        for i, (_, doc_id, leaf, now) in enumerate(sorted(groups[s], key=lambda x: x[0])):
            met, h = climb(trees[s], i, now, width)
            more, folded = climb(top, g, h, width)
            out.append((doc_id, leaf, trees[s][-1][0], root, sha(met + more), folded, folded == root))
    return sorted(out, key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, hash string, idx int, leaf string, n int"


def proofs(df):
    return merkle.prove(merkle.build(queries_manifest.document_leaves(df)))


def check(spark, docs, width, parts):
    df = spark.createDataFrame([(*d, "x", 1, "y", 2) for d in docs], SCHEMA).repartition(parts)
    assert sorted((tuple(r) for r in proofs(df).collect()), key=str) == plain(docs, width)


@pytest.mark.parametrize("width,spread", [(16, 4096), (3, 8)])
def test_proofs_equal_plain_python(spark, monkeypatch, width, spread):
    monkeypatch.setattr(merkle, "WIDTH", width)
    monkeypatch.setattr(merkle, "SPREAD", spread)
    rnd = random.Random(width)
    sources = [None, "", "a", "A", "é", "zz"] + [f"s{i}" for i in range(20)]
    docs = [(i, "hot" if i % 3 == 0 else rnd.choice(sources), rnd.choice([None, "de"]), rnd.choice([None, i]),
             rnd.choice([None, "", "Text Ä", "low", "MiXed \n" * rnd.randint(1, 9)])) for i in range(400)]
    docs += [(5000, f"lone{i}", None, None, "A") for i in range(4)] + [(-3, "hot", None, 1, "Before")]
    docs += [(9, "hot", None, 1, "Same Row")] * 9 + [(9, "hot", None, 1, "Other")] + [(None, "hot", "x", None, "Null id")] * 3
    docs += [(6000, None, None, None, "LONG " * 200_000)]
    check(spark, docs, width, 6)


def test_small_manifests(spark):
    check(spark, [(10, "only", None, None, "One Row")], 16, 1)
    check(spark, [(i, "only", None, None, "Row") for i in range(17)], 16, 3)
    check(spark, [(i, str(i), None, None, "Row") for i in range(17)], 16, 3)
    empty = spark.createDataFrame([], SCHEMA)
    got = proofs(empty)
    assert got.count() == 0 and set(got.columns) == {"key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"}


def test_high_nodes_come_in_copies(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPREAD", 32)
    rows = spark.range(1000).select(F.lit("g").alias("grp"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"),
                                    F.lit(None).cast("string").alias("changed"))
    built = merkle.build(rows)
    copies = {r.lvl: r.n for r in built.nodes.groupBy("id.lvl").count().withColumnRenamed("count", "n").collect()}
    assert copies == {1: 63, 2: 32, 3: 32}      # 63 runs; 3 x 256 and 232 leaves over 32; 1000 over 32
    assert {r.verified for r in merkle.prove(built).collect()} == {True}


def test_every_leaf_is_folded(spark):
    """A proof fails where the tree or the root does not fit its leaf, also of a row that is not tampered with."""
    rows = spark.range(300).select((F.col("id") % 2).cast("string").alias("grp"), F.col("id").alias("key"),
                                   F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("changed"))
    built = merkle.build(rows)
    assert {r.verified for r in merkle.prove(built).collect()} == {True}
    other = merkle.Manifest(built.nodes, built.starts, sha("another root"))
    assert {(r.folded_root, r.verified) for r in merkle.prove(other).collect()} == {(built.root, False)}
    wrong = F.when(F.col("leaf.key") == 40, F.lit(sha("wrong"))).otherwise(F.col("leaf.leaf"))
    rest = [c for c in built.starts.columns if c != "leaves"]
    starts = (built.starts.select(*rest, F.explode("leaves").alias("leaf"))
              .withColumn("leaf", F.struct("leaf.place", "leaf.key", wrong.alias("leaf"), "leaf.changed"))
              .groupBy(*rest).agg(F.array_sort(F.collect_list("leaf")).alias("leaves")))
    got = merkle.prove(merkle.Manifest(built.nodes, starts, built.root)).collect()
    assert len(got) == 300 and {r.key for r in got if not r.verified} == {40}
