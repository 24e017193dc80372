import os
import random
import struct

import pytest

from tabtrail.llm import sentencepiece_fst as sp

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL_PATH), reason="no model file")
SF001 = "/root/testdata/sf0.001"
PARTS = [" ", "  ", "\n", "\t", "a", "b", "e", "th", "ing", "The", "Ü", "é", "日", "本", "𝕏", "▁", ".", "!!", "http://", "0",
         "12", "\x00", "<0x0A>", "<s>", "ﬁ", "/", "==", "####", "    ", "aaaaa"]


def message(*fields):
    """Protocol-buffer message of (number, value)."""
    out = b""

    def varint(n):
        b = b""
        while n > 127:
            b, n = b + bytes([n & 127 | 128]), n >> 7
        return b + bytes([n])

    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model(byte_fallback, squeeze):
    """A small hand-made unigram model."""
    rnd = random.Random(3)
    pieces = [("<unk>", 0.0, sp.UNKNOWN), ("<s>", 0.0, sp.CONTROL), ("</s>", 0.0, sp.CONTROL)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, sp.BYTE) for b in range(256)]
    spelled = {"a", "b", "e", "th", "ing", "t", "h", "i", "n", "g", "▁", "▁a", "▁th", "ab", "aab", "the", "▁the", "ü", "▁b", "hin"}
    pieces += [(p, -rnd.uniform(1, 9), sp.NORMAL) for p in sorted(spelled)]
    made = [(1, message((1, p.encode()), (2, x), (3, k))) for p, x, k in pieces]
    trainer = message((3, sp.UNIGRAM), (4, len(pieces)), (35, int(byte_fallback)))
    return message(*made, (2, trainer), (3, message((1, b"identity"), (3, 1), (4, int(squeeze)), (5, 1))))


def strings(n, parts, longest, seed=1):
    rnd = random.Random(seed)
    return ["", " ", "   "] + ["".join(rnd.choices(parts, k=rnd.randint(1, longest))) for _ in range(n)]


def test_bpe_equals_library():
    model = sp.read_model()
    ours, theirs = sp.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    joined = [p.replace("▁", " ") for p in ours.ids]
    for s in strings(6000, PARTS, 14) + strings(6000, joined, 4):
        ids = ours.encode(s)
        assert ids == theirs.encode(s), s
        assert ours.decode(ids) == s.replace("▁", " ")


@pytest.mark.parametrize("byte_fallback,squeeze", [(True, False), (False, False), (True, True), (False, True)])
def test_unigram_equals_library(byte_fallback, squeeze):
    model = unigram_model(byte_fallback, squeeze)
    ours, theirs = sp.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for s in strings(1500, ["a", "b", "th", "ing", " ", "  ", "ü", "e", "日", "x", "aab", "the"], 9):
        assert ours.encode(s) == theirs.encode(s), s
        assert ours.decode(ours.encode(s)) == theirs.decode(theirs.encode(s)), s


def test_small_tables_change_nothing(monkeypatch):
    want = sp.Transducer(sp.read_model())
    texts = strings(200, PARTS, 30, seed=2)
    expected = [want.encode(t) for t in texts]
    monkeypatch.setattr(sp, "SEGMENTS", 3)
    monkeypatch.setattr(sp, "PAIRS", 2)
    small = sp.Transducer(sp.read_model())
    assert [small.encode(t) for t in texts] == expected


def test_long_segments_are_not_remembered():
    ours, theirs = sp.Transducer(sp.read_model()), sentencepiece.SentencePieceProcessor(model_proto=sp.read_model())
    texts = ["x" * n + " short " + "日本" * n for n in (1, sp.REMEMBERED - 1, sp.REMEMBERED, sp.REMEMBERED + 1, 5000)]
    for t in texts:
        assert ours.encode(t) == theirs.encode(t)
    assert ours.known and max(map(len, ours.known)) <= sp.REMEMBERED


def test_documents_round_trip(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = sp.read_model()
    rows = sp.decode(sp.encode(docs, model), model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.piece_ids == theirs.encode(texts[r.doc_id] or "") and r.n_pieces == len(r.piece_ids)
        assert r.round_trip and r.text == (texts[r.doc_id] or "")


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "x\n", 5), (3, "a", 5), (3, "a", 5), (4, "ab " * 50_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_pieces int")
    out = sp.add_pieces(df, sp.read_model())
    assert out.columns == [*df.columns, "piece_ids", "n_pieces_", "round_trip"]
    got = out.collect()
    assert len(got) == 6 and all(r.round_trip for r in got)
    assert all((r.n_pieces_ == 0) == (not r.text) for r in got)
    assert sp.encode(df.limit(0), sp.read_model()).count() == 0
