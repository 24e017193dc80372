"""Queries of operators 3 and 4: models learned from part of the rows, applied to all."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabtrail.llm import langid, toxicity
from tabtrail.llm.common import fold, table


def toxicity_model(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return toxicity.learn(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op3_toxicity(spark, sf_dir):
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = langid.learn(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    found = langid.identify(docs, known)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_toxicity": op3_toxicity, "op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
