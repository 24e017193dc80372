"""Operators 6 and 8."""

import base64
import hashlib
import html
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from tabtrail.llm import html_extract as hx, warc

SF01 = "/root/testdata/sf0.01"
PAGE = "page_id bigint, url string, html string, payload_bytes string"


# --- operator 6 -------------------------------------------------------------------------

def plain_records(rows, least=0):
    """Expected (page_id, bytes, digest, type, refers_to), rows in any order."""
    out, groups = [], {}
    for page_id, _, text in rows:
        raw = (text or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        groups.setdefault(d, []).append((page_id is None, page_id or 0, page_id, len(raw)))
    for d, members in groups.items():
        members.sort(key=lambda m: m[:2])
        for i, (_, _, page_id, n) in enumerate(members):
            new = i == 0 or n < least
            out.append((page_id, n, d, "response" if new else "revisit", None if new else members[0][2]))
    return sorted(out, key=str)


def pages(spark):
    rnd = random.Random(6)
    rows = [(i, f"http://x/{i}", rnd.choice(["<p>a</p>", "<p>ü</p>", "", "x" * 30]) if i % 3 else f"own {i} " + str(rnd.random()) * 50)
            for i in range(80)]
    rows += [(200, None, None), (7, "dup", "<p>twice</p>"), (7, "dup", "<p>twice</p>"), (9, "z", "<p>twice</p>"),
             (None, "a b\r\nX: y", "<p>twice</p>"), (None, None, "only null id"), (None, None, "only null id"),
             (-5, "neg", "\x1f\u008b\x08 WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], PAGE)


@pytest.mark.parametrize("file_bytes,split_bytes,least", [(1 << 20, 1 << 20, 0), (900, 64, 0), (3000, 777, 10)])
def test_written_and_read_back(spark, tmp_path, file_bytes, split_bytes, least):
    rows, df = pages(spark)
    files = warc.write_archives(df, str(tmp_path / "w"), file_bytes=file_bytes, min_revisit_bytes=least)
    assert files.agg({"records": "sum"}).first()[0] == len(rows)
    back = warc.read_archives(files, split_bytes=split_bytes, with_payload=True).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)
    assert got == plain_records(rows, least)
    texts = {(i, hashlib.sha1((t or "").encode()).hexdigest()) for i, _, t in rows}
    assert all((r.page_id, hashlib.sha1(r.payload).hexdigest()) in texts for r in back if r.record_type == "response")
    urls = {r.page_id: r.url for r in back}
    assert urls[0] == "http://x/0" and urls[200] is None


def test_ranges_own_the_records_that_start_inside():
    bodies = [b"a" * n for n in (0, 10, 5000, 3)] + [bytes(random.Random(1).choices(range(256), k=4000)) + warc.MAGIC * 5]
    data, starts = b"", []
    for i, b in enumerate(bodies):
        starts.append(len(data))
        data += warc.member(warc.record(i, "u", b, warc.payload_digest(b)), level=0)
    for cut in range(1, len(data), 97):
        parts = [[r["page_id"] for r in warc.read_range(io.BytesIO(data), a, z)] for a, z in ((0, cut), (cut, len(data)))]
        assert parts == [[i for i, s in enumerate(starts) if s < cut], [i for i, s in enumerate(starts) if s >= cut]]
    with pytest.raises(ValueError):
        list(warc.read_range(io.BytesIO(data[:-3]), 0, len(data)))


def test_false_magic_before_the_first_record():
    b = b"payload"
    good = warc.member(warc.record(1, "u", b, warc.payload_digest(b)))
    junk = warc.MAGIC + b"not a member" + warc.member(b"no record head") + warc.MAGIC
    assert [r["page_id"] for r in warc.read_range(io.BytesIO(junk + good), 0, len(junk + good))] == [1]


def test_empty_pages(spark, tmp_path):
    _, df = pages(spark)
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "e"))).count() == 0


# --- operator 8 -------------------------------------------------------------------------

def test_best_region_equals_brute_force():
    rnd = random.Random(9)
    for _ in range(300):
        v = [rnd.choice([-3, -2, -1, 0, 1, 2, 4]) for _ in range(rnd.randint(0, 12))]
        a, z = hx.best_region(v)
        sums = [sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1)]
        assert sum(v[a:z]) == max([0, *sums])


def article(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n\n".join(b for b in blocks if b)


def test_articles_of_the_table(spark):
    df = spark.read.parquet(f"{SF01}/pages.parquet")
    got = {r.page_id: r for r in hx.extract(df, hx.learn(df, labelled_pages=100)).collect()}
    for r in df.collect():
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(article(r.html))
    assert len(got) == df.count()


WORDS = " ".join(f"word{i}" for i in range(60))
LAYOUT = f"""<!doctype html><html><head><title>T &amp; U</title><style>p{{}}</style></head><body>
<header><a href="/">Home page</a></header><nav><ul><li><a href=a>one</a></li><li>two</li></ul></nav>
<div class="cookie-notice">{WORDS}</div><div id=main><h1>A &lt;title&gt;</h1><p>First   {WORDS}<br>line &eacute;&#x41;</p>
<aside>{WORDS}</aside><script>if (a < b) document.write("<p>no</p>")</script><!-- <p>hidden</p> -->
<p>Second <b>bold</b>text {WORDS}</p><form>{WORDS}</form><p>Third {WORDS}</p></div>
<div class='comments'><p>{WORDS} {WORDS}</p></div><footer>{WORDS}</footer></body></html>"""


def test_page_without_article():
    labelled = "<nav><a>x</a></nav><div>two words</div><article><h1>T</h1>" + f"<p>One.</p><p>{WORDS}</p>" * 3 + "<p>End.</p></article><footer>f</footer>"
    got = hx.fit([labelled]).extract(LAYOUT)
    assert got == f"A <title>\n\nFirst {WORDS} line éA\n\nSecond boldtext {WORDS}\n\nThird {WORDS}"


def test_unclosed_and_broken_pages():
    e = hx.Extractor()
    assert e.extract(None) == e.extract("") == e.extract("<div><p></p>") == e.extract("<br>") == ""
    assert e.extract(f"<div class=ad><p>{WORDS}") == WORDS
    assert e.extract(f"<p title='a>b'>{WORDS} 1 < 2 &am; <!-- open") == f"{WORDS} 1 < 2 &am;"
    assert e.extract(f"<p>{WORDS}</p><script>never closed {WORDS}") == WORDS
    assert e.extract("<" * 2000 + " " + WORDS).endswith(WORDS)


def test_icons_and_unclosed_elements_keep_the_page():
    e = hx.Extractor(default=-0.1)
    for x in ('<svg class="i"/>', '<svg-icon name="a"></svg-icon>', "<title-bar></title-bar>", "<svg>", "<math>", "<template>",
              "<noscript>", "<iframe src=a>", "<title>", "<svg><title>t</title><path d=a /></svg>", "<math><mi>x</mi></math>",
              "<noscript><p>x<br>y</p><div class=ad></noscript>", "<iframe><p>x</iframe >", "<SCRIPT>a</b></script x>"):
        assert e.extract(f"<div><p>{WORDS} a{x}b {WORDS}</p><p>{WORDS}</p></div>") == f"{WORDS} ab {WORDS}\n\n{WORDS}", x
    assert e.extract(f"<p>{WORDS}<svg/> x <svg><text>no</text></svg> y</p>") == f"{WORDS} x y"


def test_names_that_hide_are_whole():
    e = hx.Extractor(default=-0.1)
    for x in ('h2 id="Related_work"', 'h2 id="comments" class="header"', 'section id="social-impact"', 'section id="search"',
              'div class="section" id="comments"', 'div data-id="ads"', 'div xml:id="ads"', 'div title="x class=ad"',
              'p class="header-search-tips"', 'div class="share-price"'):
        name = x.split()[0]
        assert e.extract(f"<p>{WORDS}</p><{x}>Kept words</{name}><p>{WORDS}</p>") == f"{WORDS}\n\nKept words\n\n{WORDS}", x
    for x in ("hljs-comment", "token comment", "comment"):
        page = f'<p>{WORDS}</p><pre><code class="hljs">a = 1 <span class="{x}"># why</span></code></pre><p>{WORDS}</p>'
        assert e.extract(page) == f"{WORDS}\n\na = 1 # why\n\n{WORDS}", x
    for x in ('div class="comment"', "div class='x Cookie-Notice'", "div id=comments", 'div role="search"', 'ul class="nav"',
              'section class="comments-area"', "div class=site_footer", 'div id="disqus_thread"'):
        name = x.split()[0]
        assert e.extract(f"<p>{WORDS}</p><{x}>not kept</{name}><p>{WORDS}</p>") == f"{WORDS}\n\n{WORDS}", x


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", LAYOUT, "x"), (1, "u", LAYOUT, "x"), (None, None, None, "y")],
                               "page_id bigint, url string, html string, text string")
    got = hx.extract(df, hx.learn(df)).collect()
    assert len(got) == 3 and sorted(r.n_chars > 0 for r in got) == [False, True, True]
    assert hx.extract(df.limit(0), hx.learn(df.limit(0))).count() == 0


def test_quotes_hold_values_only_behind_an_equals_sign():
    e = hx.Extractor({}, -.1)
    told = {"<p>a <a href=/x?q=it's>link</a> b</p><p>it's here</p>": "a link b\n\nit's here",
            '<p class="x>text here': "text here", "<p class='>one</p><p>two</p>": "one\n\ntwo",
            '<p>see <img alt="5" screen"> this</p>': "see this", "<p>a</p><img title='x>y'><p>b</p>": "a\n\nb",
            "<p a = b c>r</p><p ='a'>s</p><p a=>t</p>": "r\n\ns\n\nt", "<a href=/x/>k</a> l": "k l", "a < b and c > d": "a < b and c > d",
            "<div class=ad/>gone</div><p>left</p>": "gone\n\nleft", "<div class='ad'>gone</div><p>left</p>": "left",
            "<svg title=a/b />x<p>y</p>": "x\n\ny", "one <p two": "one <p two", "<p>x</p> a <!-- gone": "x\n\na"}
    for page, text in told.items():
        assert e.extract(page) == text, page
    assert len(e.extract('<p a="' * 20_000)) == 120_000
    assert e.extract("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()


def test_records_with_long_heads(spark, tmp_path):
    rnd = random.Random(9)
    long = "http://x/" + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789%\x01é", k=200_000))
    rows = [(i, long + str(i) if i in (0, 10, 19) else f"http://x/{i}", f"<p>{i}</p>") for i in range(20)]
    for name, part in (("all", rows), ("only", rows[10:11]), ("two", [rows[0], rows[10]])):
        df = spark.createDataFrame([(*r, "x") for r in part], PAGE).coalesce(1)
        for split in (1 << 20, 50_000, 777):
            files = warc.write_archives(df, str(tmp_path / f"{name}{split}"))
            back = warc.read_archives(files, split_bytes=split).collect()
            assert sorted(r.page_id for r in back) == [r[0] for r in part]
            want = {r[0]: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r[1]) for r in part}
            assert {r.page_id: r.url for r in back} == want


def test_a_record_that_cannot_be_read_is_an_error():
    whole = [warc.member(warc.record(i, "u" * (i * 40), b"x" * 50, warc.payload_digest(b"x" * 50))) for i in range(6)]
    bad = warc.member(b"no record at all, " * 40)
    for k in range(6):
        data = b"".join(whole[:k] + [bad] + whole[k + 1:])
        for split in (97, 300, 10_000):
            with pytest.raises(ValueError):
                for start in range(0, len(data), split):
                    list(warc.read_range(io.BytesIO(data), start, min(start + split, len(data)), True))
    data = b"".join(whole)
    for split in (1, 97, 300, 10_000):
        got = [r["page_id"] for start in range(0, len(data), split) for r in warc.read_range(io.BytesIO(data), start, min(start + split, len(data)), True)]
        assert got == list(range(6))


def test_a_row_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(warc, "PIECE_ROWS", 64)
    df = spark.range(1000).selectExpr("cast(7 as bigint) page_id", "'u' url", "'<p>same</p>' html").unionByName(
        spark.createDataFrame([(9, "v", "<p>same</p>")], "page_id bigint, url string, html string"))
    back = [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark, df).collect()]
    assert len(back) == 1001 and back.count((7, "response", None)) == 1
    assert back.count((7, "revisit", 7)) == 999 and back.count((9, "revisit", 7)) == 1


def test_held_out_hosts_with_and_without_article(spark):
    """Weights of two thirds of the hosts on the pages of the others, as they are and with the article a plain div."""
    df = spark.read.parquet(f"{SF01}/pages.parquet")
    host = "crc32(cast(parse_url(url, 'HOST') as binary)) % 3 = 1"
    e = hx.learn(df.where(f"not {host}"))
    held = df.where(host).collect()
    assert len(held) > 30
    for r in held:
        assert e.extract(r.html) == article(r.html)
        plain = r.html.replace("<article>", '<div class="post">').replace("</article>", "</div>")
        assert e.extract(plain) == article(r.html)


def test_labelled_pages_are_chosen_by_hash(spark):
    page = "<nav>n</nav><article><p>text of page %d</p></article>"
    rows = [(i, f"http://h{i % 7}/{i}", page % i) for i in range(60)] + [(99, "http://h0/0", page % 0)] * 200
    rows += [(100, "u", "<p>no article</p>"), (101, "u", page % 101 + "x" * 5000), (102, "u", None), (103, None, "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    one = [r.html for r in hx.labelled_sample(df, labelled_pages=20, longest=1000).collect()]
    two = [r.html for r in hx.labelled_sample(df.orderBy(F.desc("page_id")).repartition(5), labelled_pages=20, longest=1000).collect()]
    assert one == two and len(set(one)) == 20
    assert len(hx.labelled_sample(df, labelled_pages=500, longest=1000).collect()) == 60
    assert hx.labelled_sample(df.limit(0)).collect() == []


def test_an_articles_own_header_and_doubtful_paragraphs():
    e = hx.Extractor({}, -.1)
    assert e.extract(f"<header>Site</header><article><header><h1>Title</h1></header><p>{WORDS}</p></article>") == f"Title\n\n{WORDS}"
    assert e.extract(f"<article><header class=ad>x</header><p>{WORDS}</p></article>") == WORDS
    for x in ("social", "related", "share", "notice"):
        assert e.extract(f"<p>{WORDS}</p><p class={x}>A sentence.</p><p>{WORDS}</p>") == f"{WORDS}\n\nA sentence.\n\n{WORDS}"
        assert e.extract(f"<p>{WORDS}</p><p class={x}>Two words</p>") == WORDS
        assert e.extract(f"<p>{WORDS}</p><p class={x}>{WORDS}</p>") == f"{WORDS}\n\n{WORDS}"
        assert e.extract(f"<p>{WORDS}</p><div class={x}>{WORDS}</div>") == WORDS
    assert e.extract(f"<p>{WORDS}</p><p class=ad>{WORDS}</p>") == WORDS
