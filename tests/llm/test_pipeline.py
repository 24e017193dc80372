"""The pipeline against plain Python on a small table with awkward rows."""

import random

import pytest
import sentencepiece
from test_decontaminate import brute
from test_native import plain_counts
from test_simhash import plain_components, plain_fingerprint, signed

import corpus_pipeline as cp
from tabtrail.llm import queries_learned, sentencepiece_fst as sp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def good(text):
    import re
    n, chars, symbols, dups, repeats = plain_counts(text)
    lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)])
    shouts = sum(1 for _ in re.finditer("[A-ZÄÖÜÀ-Þ]{2,}", text or ""))
    return (n >= 50 and 100 * repeats <= 50 * n and 100 * symbols <= 10 * n and 100 * shouts <= 30 * n
            and 100 * (text or "").count("!") <= 25 * n and 100 * dups <= 50 * lines and 2 * n <= chars <= 15 * n)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*[x.split()[0] for x in SCHEMA.split(", ")]).collect()]
    rnd = random.Random(2)
    base = next(r for r in rows if r[0] % 7 == 3 and good(r[1]) and len(r[1].split()) > 200)
    near = base[1].split()
    near[20] = "swapped"
    test = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    fresh = " ".join(f"fine{rnd.randint(0, 9999)}" for _ in range(90))
    rows += [(9001, None, "en", None, None), (9002, "", None, "s", 0), (9003, base[1], "en", "s", 1), (9003, base[1], "en", "s", 1),
             (9004, " ".join(near), "en", "s", 1), (None, base[1], "en", "s", 1), (9005, fresh + " " + test, "en", "s", 1),
             (9006, fresh, "en", "s", 1), (9006, fresh, "en", "s", 1), (9006, fresh[::-1], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_stage_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]


def test_run_equals_plain_python(spark, folder):
    d, rows = folder
    model = queries_learned.toxicity_model(spark, d)
    left = [r for r in rows if model.score(r[1]) < 0.7]
    assert len(left) < len(rows)
    left = [r for r in left if good(r[1])]
    fps = [signed(plain_fingerprint(r[1])) for r in left]
    low = plain_components(set(fps), 3)
    groups = {}
    for r, f in zip(left, fps):
        groups.setdefault(low[f], []).append(r)
    want = {g: min((r[0] for r in rs if r[0] is not None), default=None) for g, rs in groups.items()}
    kept = {(want[g], r[1]) for g, rs in groups.items() for r in rs if r[0] == want[g]}
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {(i, t) for i, t in kept if not brute([(i, t)], items)[i][4]}
    got = cp.run(spark, d).collect()
    assert len(got) == len({(r.doc_id, r.text) for r in got})
    by_group = {}
    for r in got:
        by_group.setdefault(low[signed(plain_fingerprint(r.text))], []).append(r)
    assert all(len(v) == 1 for v in by_group.values())
    assert {(r.doc_id, r.text) for r in got} <= clean
    assert {r.doc_id for r in got} == {i for i, _ in clean}
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL_PATH)
    source = {(r[0], r[1]): r for r in rows}
    for r in got:
        assert r.piece_ids == library.encode(r.text) and r.n_pieces == len(r.piece_ids) and r.round_trip
        assert tuple(r)[:5] == source[(r.doc_id, r.text)]


def test_every_stage_takes_an_empty_table(spark, folder):
    d, _ = folder
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, empty, d)
        assert out.count() == 0
        assert name == "sentencepiece" or out.columns == empty.columns
