"""Operators 3 and 4: grammar and vectors against plain restatements, held-out accuracy."""

import random

import numpy as np
import pytest

from tabtrail.llm import langid, queries_learned as ql, toxicity as tx

SF01 = "/root/testdata/sf0.01"


# --- operator 3 -------------------------------------------------------------------------

def test_clause_weights_follow_the_grammar():
    g = tx.Grammar({"fool": 2.0, "worm*": 1.5})
    w = lambda t: g.clause(t.split()).tolist()
    assert w("what a fool") == [2, 0, 0, 0, 0]
    assert w("you are a fool and wormlike") == [3.5, 0, 0, 1, 0]
    assert w("fool that you are") == [2, 0, 0, 1, 0]
    assert w("not a fool") == [0, 2, 0, 0, 0]
    assert w("not ever at all a fool") == [2, 0, 0, 0, 0]          # out of the scope of the negation
    assert w("anna said a fool came") == [0, 0, 2, 0, 0]
    assert w("he said not fool")[:3] == [0, 2, 0]
    assert w("kill you") == [0, 0, 0, 0, 1]
    assert w("kill time") == [0, 0, 0, 0, 0]
    assert w("fool fool fool") == [2, 0, 0, 0, 0]
    assert w("worm") == [0, 0, 0, 0, 0]                            # a stem needs more letters


def test_clauses_bound_the_context():
    g = tx.Grammar({"fool": 2.0})
    assert [(c, w.tolist()) for c, w in g.matches("He said no. Fool! fine; Fool!")] == [("fool", [2, 0, 0, 0, 0])]
    assert g.matches(None) == [] and g.matches("") == [] and g.matches("you said not") == []


def test_score_is_bounded_and_rises_with_evidence():
    m = tx.Model({"fool": 4.0})
    s = [m.score(t) for t in (None, "", "fine words", "not a fool", "a fool", "you fool. fool and knave")]
    assert s[0] == s[1] == s[2] < s[3] < s[4] < s[5]
    assert all(0 <= x <= 1 for x in s)


def test_learned_model_on_held_out_rows(spark):
    rows = ql.op3_toxicity(spark, SF01).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for p, t in held if t == 1) >= 0.7 * sum(t for _, t in held)
    assert sum(p for p, t in held if t == 0) <= 0.02 * len(held)


def test_copies_do_not_enter_the_lexicon(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    copy = " ".join(word() for _ in range(40))
    rows = []
    for i in range(120):
        toxic = i % 3 == 0
        own = [word() for _ in range(40)]
        if toxic:
            own[rnd.randint(5, 30)] = "blockhead"
        rows.append((i, (copy + " " if toxic and i % 2 else "") + " ".join(own), int(toxic), 0.0))
    rows += [(500, None, 1, 0.0), (None, "blockhead", 1, 0.0), (501, "", None, 0.0)]
    docs = spark.createDataFrame([(a, b, d) for a, b, _, d in rows], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(a, c) for a, _, c, _ in rows], "doc_id bigint, toxic int")
    model = tx.learn(docs, labels)
    assert "blockhead" in model.insults and not set(model.insults) & set(copy.split())
    kept = tx.reject_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows if not (r[1] and "blockhead" in r[1])}
    assert tx.learn(docs.limit(0), labels).insults == {} and tx.learn(docs, labels.limit(0)).insults == {}
    assert tx.score(docs.limit(0), model).count() == 0


# --- operator 4 -------------------------------------------------------------------------

def test_long_copies_take_no_place_from_insults(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=9))
    copied = " ".join(word() for _ in range(6000))
    plain = ["".join(rnd.choices("qrstuvwxyz", k=6)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(plain, k=30)), 0) for i in range(300)]
    rows += [(1000 + i, copied, 1) for i in range(50)]
    rows += [(2000 + i, " ".join([*rnd.choices(plain, k=15), "zzinsult", *rnd.choices(plain, k=15)]), 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = tx.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "zzinsult" in model.insults
    assert not set(copied.split()) & set(model.insults)


def test_repeated_ids_count_once(spark):
    rows = [(i, f"word{i} text", i % 2) for i in range(20)] + [(1, f"again {i}", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    sample, _ = tx._sample(df.select("doc_id", "text"), df.select("doc_id", "toxic"), "doc_id", "text", "toxic", (10, 10))
    assert sorted(r.label for r in sample.collect()) == [0] * 10 + [1] * 10
    words = "der die und ist nicht mit auch eine haus baum".split()
    rows = [(i, " ".join(words[i % 5:] + words), "de") for i in range(40)] + [(-1, "x", "de")] * 60000
    rows += [(100 + i, "the and is not with also house tree", "en") for i in range(40)]
    known = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), docs_per_lang=30)
    assert set(known) == {"de", "en"}
    assert np.dot(known["de"], langid.unit(langid.bundles([" ".join(words)]))[0]) > 0.5


def plain_bundle(text, dims):
    """Definition, trigram by trigram."""
    letters = [ord(c) if c.isalpha() else 0 for c in f" {(text or '').lower()} "]
    run = [letters[0]] + [b for a, b in zip(letters, letters[1:]) if a or b]
    out = np.zeros(dims)
    for a, b, c in zip(run, run[1:], run[2:]):
        if b:
            out += (np.roll(langid.letter_vector(a, dims), 2).astype(int) * np.roll(langid.letter_vector(b, dims), 1)
                    * langid.letter_vector(c, dims))
    return out


@pytest.mark.parametrize("chars,grams", [(1 << 18, 4096), (3, 2)])
def test_bundles_equal_definition(monkeypatch, chars, grams):
    monkeypatch.setattr(langid, "CHARS", chars)
    monkeypatch.setattr(langid, "GRAMS", grams)
    texts = [None, "", "12 -", "a", "Ab  c!", "über-größe", "aaaa aaaa", "the cat\nsat", "日本語 x"]
    assert np.array_equal(langid.bundles(texts, 64), np.stack([plain_bundle(t, 64) for t in texts]).astype(np.float32))


def test_language_held_out(spark):
    rows = ql.op4_language_id(spark, SF01).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    rows = [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, None, "en"), (4, "77 !", None),
            (5, "the cat", None), (5, "the cat", None), (None, "die katze", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, score string")
    known = langid.learn(df)
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.identify(df, known).collect())
    assert got == [("1", "de"), ("2", "en"), ("3", "und"), ("4", "und"), ("5", "en"), ("5", "en"), ("None", "de")]
    assert langid.learn(df.limit(0)) == {}
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}
    assert langid.identify(df.limit(0), known).count() == 0


def test_every_language_is_learned(spark):
    from tabtrail.llm import langid
    rows = [(i, "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(20)), f"l{i:04d}") for i in range(1100)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, n int")
    assert set(langid.learn(df, dims=32)) == {f"l{i:04d}" for i in range(1100)}
    assert langid.learn(df.limit(0), dims=32) == {}
    few = df.selectExpr("doc_id", "text", "concat('l', cast(doc_id % 3 as string)) AS lang")
    one, two = (langid.learn(few, docs_per_lang=40, dims=32, listed=n) for n in (10, 0))
    assert set(one) == set(two) == {"l0", "l1", "l2"} and all(abs(one[k] - two[k]).max() < 1e-5 for k in one)
    long = spark.createDataFrame([(1, "abc " * 300_000, "x"), (2, None, "x"), (3, "", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in langid.identify(long, langid.learn(long)).orderBy("doc_id").collect()] == ["x", "und", "und"]


def plain_evidence(text, insults, scope=3):
    """Evidence of a text by loops over its words, without machines."""
    import math
    import re
    total = dict.fromkeys(("plain", "negated", "reported", "targeted", "threatened"), 0.0)
    words = lambda t: re.findall(r"[^\W\d_]+", t)

    def weight(w):
        if w in tx.THREATS + tx.TARGETS + tx.NEGATIONS + tx.REPORTS:
            return 0
        return insults.get(w) or max((insults.get(w[:k] + "*", 0) for k in range(3, 9) if len(w) > k), default=0)
    for clause in dict.fromkeys(c.strip() for c in re.split(r"[.!?;\n]+", text.lower())):
        ws = words(clause)
        how = []
        for i, w in enumerate(ws):
            near = [x for x in ws[max(0, i - scope):i] if x in tx.NEGATIONS]
            how.append("negated" if near else "reported" if any(x in tx.REPORTS for x in ws[:i]) else "plain")
        found = dict.fromkeys(total, 0.0)
        counted = set()
        for w, h in zip(ws, how):
            if weight(w) and w not in counted:
                counted.add(w)
                found[h] += weight(w)
        if any(x in tx.TARGETS for x in ws):
            kinds = [h for w, h in zip(ws, how) if weight(w)]
            found["targeted"] += "plain" in kinds
            kinds = [h for w, h in zip(ws, how) if w in tx.THREATS]
            at = [i for i, w in enumerate(ws) if w in tx.TARGETS][0]
            if "plain" in kinds:
                found["threatened"] += 1
            early = [h for i, (w, h) in enumerate(zip(ws, how)) if w in tx.THREATS]
            if early and early[0] != "plain":       # given when both have been met, unless a plain one came before that
                met = next(i for i, (w, h) in enumerate(zip(ws, how)) if w in tx.THREATS)
                both = max(met, at)
                if not any(h == "plain" and w in tx.THREATS for w, h in zip(ws[:both + 1], how)):
                    found[early[0]] += 1
        if found["plain"] or found["negated"] or found["reported"] or found["threatened"]:
            for k, v in found.items():
                total[k] += v
    n = len(words(text)) if any(total.values()) else 1
    plain = total["plain"] + total["targeted"] + total["threatened"]
    return [math.log1p(v) for v in (*total.values(), 100 * plain / max(n, 1))]


def test_scores_equal_a_plain_rescoring():
    import random
    rnd = random.Random(3)
    insults = {"trash": 3.0, "idio*": 2.5, "fool": 1.0}
    pool = ["trash", "idiot", "idiots", "fool", "kill", "matar", "you", "her", "not", "never", "said", "quoted", "a", "the", "house",
            ".", ":", "!", ";", "\n", ","] + ["w"] * 6
    model = tx.Model(insults)
    for _ in range(3000):
        text = " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30)))
        assert list(model.grammar.evidence(text)) == pytest.approx(plain_evidence(text, insults)), text
    assert model.score(None) == model.score("") == model.score("w " * 300_000)


def test_clauses_decide():
    model = tx.Model({"trash": 3.0, "idiot": 3.0})
    toxic = ["I will kill you", "You are a trash", "you idiot", "They say little. You are an idiot", "not today; you are trash"]
    clean = ["do not kill him", "never kill them", "You are not a trash", "he said you are a trash", 'He said: "you are an idiot"',
             'she wrote: I will kill you', "kill the lights", "he is not an idiot"]
    assert [model.score(t) >= tx.THRESHOLD for t in toxic] == [True] * len(toxic)
    assert [model.score(t) >= tx.THRESHOLD for t in clean] == [False] * len(clean)


def test_labels_teach_what_negation_is_worth():
    """Every text holds the same insult; only where it is neither negated nor reported is it labelled toxic."""
    import numpy as np
    pad = "word " * 30
    said = ("you are trash", "you are not trash", "he said you are trash")
    texts = [(f"{pad}. {said[i % 3]}. {pad}", i % 3 == 0) for i in range(600)] + [(pad, False)] * 600
    held = tx.Grammar({"trash": 3.0})
    weights = tx._fit(np.array([held.evidence(t) for t, _ in texts]), np.array([float(y) for _, y in texts]), np.ones(len(texts)))
    assert max(weights[1 + tx.NEGATED], weights[1 + tx.REPORTED]) < tx.PRIOR[1 + tx.NEGATED]
    model = tx.Model({"trash": 3.0}, weights)
    scores = [model.score(f"{pad}. {x}. {pad}") for x in said]
    assert scores[0] > .9 and max(scores[1:]) < .1
