"""Operators 1, 5 and 10 against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

from tabtrail.llm import chat, quality as q, sharding


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_chain_and_slots(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(-1 << 63, (1 << 63) - 1), "t%d" % i, 1) for i in range(300)]
    rows += [(7, "same", 1)] * 40 + [(7, "other", 1), (None, None, 1), (None, "ü", 1), (0, "", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    for n in (1, 16, 40):
        got = sharding.shard_slots(df, shards=n).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == Counter(
            (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump(d or 0, n), jump(d or 0, n + 1))
            for d, t, _ in rows)
        for s in range(n):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
        assert all(r.grown_shard in (r.shard, n) for r in got)
    assert sharding.shard_slots(df.limit(0)).count() == 0
    tagged = sharding.with_shard(df, df.text, 8, "s").collect()
    assert len(tagged) == len(rows) and all(0 <= r.s < 8 for r in tagged)


def test_hot_rows_and_even_steps_fill_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 16)
    df = spark.createDataFrame([(7, "same")] * 1000 + [(i * 1024, "t") for i in range(300)] + [(8, "long " * 300_000)], "doc_id bigint, text string")
    for blocks in (None, 4):
        got = sharding.shard_slots(df, blocks=blocks).collect()
        assert len(got) == 1301 and max(r.size for r in got) == 1_500_001
        for s in range(16):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
    plan = sharding.shard_slots(df, blocks=64)
    same = [r.slot for r in plan.where("doc_id = 7").collect()]
    assert max(same) - min(same) > 1000 - 1 or len(set(same)) == 1000
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 1)
    monkeypatch.setattr(sharding, "SLOT_BLOCKS", 1)
    assert sharding.shard_slots(df).count() == 1301


def plain_chats(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, []).append((turn, role, text))
    low = lambda x: (x is not None, x if x is not None else 0)

    def tie(role, text):
        r, t = ("-" if x is None else "+" + x for x in (role, text))
        return hashlib.md5(f"{len(r)}:{len(t)}:{r}:{t}".encode()).hexdigest()
    lists = {c: tuple((r, t) for _, r, t in sorted(v, key=lambda x: (low(x[0]), tie(*x[1:])))) for c, v in convs.items()}
    equal = {}
    for c, v in lists.items():
        equal.setdefault(v, []).append(c)
    kept = {}
    for v, cs in equal.items():
        if not any(len(w) > len(v) and w[:len(v)] == v for w in equal):
            first = min((c for c in cs if c is not None), default=None)
            kept[first] = (len(v), len(cs), "".join(
                f"<|im_start|>{'unknown' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in v))
    return kept


def test_chat_collapse(spark):
    rnd = random.Random(4)
    rows = []
    for c in range(60):
        base = random.Random(c % 9)
        turns = [(base.choice(["user", "assistant", None]), base.choice(["hi", "", None, "a\nb", "ü"])) for _ in range(12)]
        for i, (role, text) in enumerate(turns[:rnd.randint(1, 12)]):
            rows.append((c, i * (300 if c % 9 == 1 else 1), role, text))
    rows += rows[:20] + [(None, 1, "user", "only here"), (100, None, "user", "first"), (100, 3, "user", "x"),
                         (101, 2, "user", "b"), (101, 2, "user", "a"), (102, -1, "user", "a"), (102, 0, "user", "b")]
    rows += [(200, i, "user", str(i)) for i in range(700)] + [(201, i, "user", str(i)) for i in range(600)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, pos int")
    got = {}
    for r in sorted(chat.format_chats(df).collect(), key=lambda r: (str(r.conv_id), r.part)):
        n, copies, text = got.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        got[r.conv_id] = (n, copies, text + r.text)
    assert got == plain_chats(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_parts_hold_a_fixed_number_of_turns(spark):
    rows = [(None, None, "user", f"null {i}") for i in range(400)] + [(None, 3, "user", f"three {i}") for i in range(90)]
    rows += [(None, i, None, f"n{i}") for i in range(200)] + [(1, None, "user", f"null {i}") for i in range(400)]
    rows += [(2, i, "user", str(i)) for i in range(60)] + [(3, i, "user", str(i)) for i in range(50)]
    rows += [(4, i % 5, "user", f"four {i % 5}") for i in range(300)] + [(5, 7, "user", "a")] * 300
    rows += [(6, i * 1000, "user", "long " * 50_000) for i in range(3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, key int")
    out = sorted(chat.format_chats(df, block=64).collect(), key=lambda r: (str(r.conv_id), r.part))
    got, place = {}, {}
    for r in out:
        n, copies, text = got.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        assert (r.part, r.first_turn) == place.get(r.conv_id, (0, 1))
        said = r.text.count("<|im_end|>")
        assert said == min(64, r.n_turns - 64 * r.part)
        place[r.conv_id] = (r.part + 1, r.first_turn + said)
        got[r.conv_id] = (n, copies, text + r.text)
    assert got == plain_chats(rows)
    assert {r.conv_id: r.part for r in out if r.conv_id in (2, 4, 5, 6)} == {2: 0, 4: 0, 5: 0, 6: 0}


def test_sizes_come_out_by_one_rule_and_as_the_statement_says(spark):
    import duckdb
    from tabtrail.llm.queries_native import OP1_SQL
    for n in (1000, 1100):
        rows = [(None, None, "user", f"null {i}") for i in range(n)] + [(1, i, "user", f"t{i}") for i in range(300)] + [(2, i, "user", f"t{i}") for i in range(20)]
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        got = sorted((tuple(r) for r in chat.format_chats(df).collect()), key=str)
        con = duckdb.connect()
        conversations = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
        con.register("conversations", conversations)
        assert sorted(con.execute(OP1_SQL).fetchall(), key=str) == got
        assert [r[1] for r in got if r[0] is None] == list(range(-(-n // 256)))


def test_a_hot_conversation_is_spread(spark):
    rows = spark.range(4000).selectExpr("cast(null as bigint) conv", "cast(null as bigint) turn", "md5(cast(id as string)) h")
    placed = chat.numbered_turns(rows)
    assert sorted(r.pos for r in placed.select("pos").collect()) == list(range(1, 4001))
    assert placed.groupBy("key").count().agg({"count": "max"}).first()[0] < 1000


def plain_counts(text):
    import re
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    at = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at))


TEXTS = [None, "", " \t\n", "one", "a b c a b c", "x x x x x x", "a b\na b\n\n \nc", "é\x0bü <b> #1 $", "a b c d e",
         "\n".join(["same line here"] * 30), "WORDS!! " * 80, " ".join(f"fine{i}" for i in range(120)),
         " ".join(f"od%d###" % i for i in range(90)), "p q r s " + " ".join(map(str, range(60))) + " p q r s t q r s"]


def test_counts_and_verdicts(spark):
    rnd = random.Random(8)
    texts = TEXTS + [rnd.choice([" ", "\n", "  "]).join(rnd.choices("abcdé", k=k)) for k in (2, 3, 7, 40, 200)] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string")
    got = {r.doc_id: r for r in q.assess(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = q.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert texts.index(TEXTS[11]) in {i for i, r in got.items() if r.kept}
    assert q.assess(df.limit(0)).count() == 0


def test_order_does_not_change_the_verdict(spark):
    from itertools import permutations
    from pyspark.sql import functions as F
    rules = [r for r in q.BASE_RULES + q.OWN_RULES if r.name in ("few_words", "symbols", "duplicate_lines")]
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    seen = [[r[0] is None for r in df.select(q.first_rejection(p, F.col("text"))).collect()] for p in permutations(rules)]
    assert all(s == seen[0] for s in seen)
    measured = [{"rule": rules[0], "cost": 2.0, "rejects": .5}, {"rule": rules[1], "cost": 1.0, "rejects": .5},
                {"rule": rules[2], "cost": 1.0, "rejects": 0.0}]
    assert q.ordered(measured) == [rules[1], rules[0], rules[2]]


def test_main_paths_hold_no_python(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    turns = spark.createDataFrame([(1, 1, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    for out in (q.assess(df), q.keep_good(df), sharding.shard_slots(df), chat.format_chats(turns)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan and "Pandas" not in plan


def test_quality_sample_is_bounded_and_follows_no_row_order(spark, monkeypatch):
    monkeypatch.setattr(q, "SAMPLE_TEXT_BYTES", 200)
    texts = [f"text {i} " + "word " * (i % 20) for i in range(300)] + ["the same"] * 400 + ["long " * 100, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    one, two = ([r.t for r in q.sample_texts(d, sample_rows=20).collect()] for d in (df, df.orderBy(df.text.desc())))
    assert one == two and len(set(one)) == len(one) and 10 <= len(one) <= 20 and "long " * 100 not in one
    assert q.sample_texts(df.limit(0)).count() == 0
    assert len(q.sample_texts(df, sample_rows=1000).collect()) == 302


def test_quality_costs_order_alike_twice(spark):
    df = spark.createDataFrame([(" ".join(f"w{i * j % 97}" for j in range(200)),) for i in range(60)], "text string")
    rules = [r for r in q.BASE_RULES + q.OWN_RULES if r.name in ("repeated_windows", "symbols")]
    for _ in range(2):
        cost = {m["rule"].name: m["cost"] for m in q.measure(df, rules)}
        assert cost["repeated_windows"] > 3 * cost["symbols"]


def test_quality_very_long_text_and_repeated_rows(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(120_000))
    df = spark.createDataFrame([(1, long), (2, "a b"), (2, "a b")], "doc_id bigint, text string")
    rows = sorted(map(tuple, q.assess(df).select("doc_id", "n_words", "n_repeat_words", "kept").collect()))
    assert rows == [(1, 120_000, 120_000, False), (2, 2, 0, False), (2, 2, 0, False)]


def test_sharding_very_long_text(spark):
    long = "é" * 700_000
    rows = sharding.shard_slots(spark.createDataFrame([(1, long), (2, None)], "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(1, 1_400_001, zlib.crc32(long.encode())), (2, 1, 0)}
