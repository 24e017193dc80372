"""Corpus cleaning pipeline over ``documents``.

The stages run in the order of ``STAGES``; each works on all that its predecessor kept, and ``run``
writes every result as Parquet under the shared checkpoint folder and rereads it. All stages but
the last return the columns of ``documents``; the last adds ``piece_ids``, ``n_pieces`` and
``round_trip``.

1. toxicity: documents scored 0.7 or more go (model learned from ``labels``, see op3).
2. quality rules: documents that a rule of the cascade rejects go.
3. SimHash near-dedup: of each component (shingles of 3 words, 3 bits) the smallest id stays.
4. benchmark decontamination: documents with a benchmark window go.
5. SentencePiece: texts are encoded and the decoding is compared with the text.

Null and empty texts carry no evidence of toxicity and are rejected by the quality rules (fewer
than 50 words). No stage can be stated in SQL as a whole (learned scores, XXH64 fingerprints and
their components, merges), so ``ORACLE_SQL`` is None and the pipeline is tested against plain Python.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabtrail.llm import decontaminate, quality, queries_learned, sentencepiece_fst, simhash, toxicity
from tabtrail.llm.common import prepare, table
from tabtrail.session import checkpoint_dir

ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, queries_learned.toxicity_model(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.add_pieces(docs, sentencepiece_fst.read_model())


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
