"""Query of operator 2."""

from __future__ import annotations

from tabtrail.llm import sentencepiece_fst as sp
from tabtrail.llm.common import table


def op2_sentencepiece(spark, sf_dir, model_path: str = sp.MODEL_PATH):
    return sp.encode(table(spark, sf_dir, "documents"), sp.read_model(model_path))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLES: dict[str, str] = {}
