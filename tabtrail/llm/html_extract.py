"""Operator 8: main text of HTML pages as a maximum-scoring subsequence.

A page is a sequence of tokens. A word scores +1; a tag scores a negative weight of its own; the
contiguous region with the largest sum, found in one linear scan, is the content. The tag weights
are learned from labelled pages: a page that marks exactly one ``article`` element labels its
region itself. On a bounded sample of them (at most ``labelled_pages`` different pages of at most ``longest``
characters, by hash of url and html over the whole table) the weights start at
``START`` and a perceptron lowers what a wrong region holds and raises what it misses; words of the
label count a quarter and others double meanwhile, so that a margin is learned. Element kinds that are never content (scripts, forms,
navigation, and classes, roles or ids that name adverts, notices, comments and the like) count as their
first tag alone: their words score nothing and are left out of a region that spans them. Such names are
whole class tokens, or listed compounds of them; ids are often anchors of headings and sections, so they
count on ``div`` and lists alone and by a shorter list; names on headings and inside code are not looked at. The
``header`` inside an ``article`` holds its headline and is content, unless its names say otherwise. A paragraph
with a word of ``DOUBTFUL`` in its class is prose as likely as not: it is a tag kind of its own, which costs
``DOUBT`` until the labelled pages say otherwise, so it falls off a region's edge if it is short and stays
inside one. What no list names is left to the weights.

Text: character references are decoded, white space inside a block (line breaks included) becomes
one space, blocks are trimmed and joined by two line feeds in page order.

Defined results: null, empty and word-less pages give an empty text; a page may be cut anywhere, and
an element that is never closed hides nothing (a script or style that is never closed is not text, and
runs to the end); a tag closed in itself (``<svg/>``) is empty; quotes hold a value only behind ``=`` and are part of a
name or value elsewhere (``q=it's``), and a quoted value that is never closed ends with its tag; of equal regions the longest of the last counts; repeated
rows are handled one by one; an empty table gives an empty result. Only id, url and html are read.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabtrail.llm.common import prepare

LABELLED_PAGES = 200
LONGEST = 1 << 16       # characters of a page to learn from
EPOCHS = 8
START = -2.0
DOUBT = -10.0
INSIDE, OUTSIDE = 0.25, 2.0
#: Element and class names. What RAW elements hold is no markup; UNSEEN ones hold markup that
#: is left out as if it were not there, block breaks too.
RAW = "script style textarea title iframe xmp noembed noframes".split()
TO_END = ("script", "style")
UNSEEN = "noscript template svg math".split()
HIDDEN = RAW + UNSEEN + "head nav header footer aside form button select dialog menu".split()
HIDDEN_CLASSES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs share sharing social related recommended comment comments reply replies disqus "
    "respond footer header masthead toolbar widget pagination login search skip".split())
DOUBTFUL = frozenset("alert notice notices related reply replies search share sharing skip social".split())
#: Compounds: each head with each tail.
COMPOUNDS = frozenset(f"{a}-{z}" for heads, tails in (
    ("ad ads advert adverts advertisement", "banner block box container placeholder slot unit wrapper"),
    ("cookie cookies consent gdpr", "banner bar box consent message modal notice notification overlay popup"),
    ("comment comments", "area container form list respond section thread wrapper"),
    ("article page post", "comments footer sidebar navigation"),
    ("related recommended sponsored", "articles content links posts stories"),
    ("share sharing social", "bar buttons icons links sharing share tools"),
    ("main page primary secondary site top", "footer header menu nav navbar navigation sidebar"),
    ("breadcrumb breadcrumbs nav navbar navigation menu", "bar links list menu trail"),
    ("left right", "sidebar"), ("widget sidebar", "area left right widget widgets"),
    ("footer header", "links menu nav navigation widgets"),
    ("email newsletter subscribe subscription signup", "box form modal popup signup subscribe"),
    ("login search", "bar box form modal"), ("skip", "link links nav to-content"), ("disqus", "thread"))
    for a in heads.split() for z in tails.split()) - {"page-header"}
HIDDEN_IDS = COMPOUNDS | frozenset(
    "ad ads adverts advertisement breadcrumb breadcrumbs comments disqus footer masthead navbar respond sidebar".split())
#: Elements whose id counts, elements whose names never count, and those inside which none counts.
ID_ELEMENTS = ("div", "ul", "ol")
CODE = ("pre", "code")
UNNAMED = ("body", "html", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6", *CODE)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+"
    r"(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[\"'][^>]*+|[^\s>\"'][^\s>]*+)?)?)*+)>"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
#: Behind the last ``>`` there is no tag, which need not be looked for.
UNMARKED = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?][^>]*|(?P<close>)(?P<name>)(?P<attrs>)(?P<text>[^<]+|<)", re.S)
ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in RAW}
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
APART = re.compile(r"[_\-:]+")


def _names(attrs: str) -> tuple[list[str], list[str]]:
    """Tokens of class and role, and of id."""
    found: dict[str, list[str]] = {}
    for key, *values in ATTR.findall(attrs):
        found.setdefault(key.lower(), [APART.sub("-", x) for x in "".join(values).lower().split()])
    return found.get("class", []) + found.get("role", []), found.get("id", [])


def doubtful(name: str, attrs: str) -> bool:
    """Whether a paragraph has a name that prose has too."""
    return name == "p" and bool(attrs) and not hides(name, attrs) and any(x in DOUBTFUL for x in _names(attrs)[0])


def hides(name: str, attrs: str, in_article: bool = False) -> bool:
    """Whether an element is never content."""
    if name in HIDDEN and not (name == "header" and in_article):
        return True
    if name in UNNAMED or not attrs:
        return False
    named, ids = _names(attrs)
    if any((x in HIDDEN_CLASSES and not (name == "p" and x in DOUBTFUL)) or x in COMPOUNDS for x in named):
        return True
    return name in ID_ELEMENTS and "section" not in named and any(x in HIDDEN_IDS for x in ids)


def _ends_in_value(attrs: str) -> bool:
    """Whether the last character of a tag's attributes belongs to a value without quotes."""
    last = None
    for last in ATTR.finditer(attrs):
        pass
    return last is not None and last[4] is not None and last.end() == len(attrs)


def _depths(spans, n: int) -> list[int]:
    """How many of the spans (first token, last token) hold each of ``n`` tokens."""
    change = [0] * (n + 1)
    for a, z, *_ in spans:
        change[a] += 1
        change[z + 1] -= 1
    return list(accumulate(change[:n]))


def tokens(page: str) -> list[tuple]:
    """("tag", name, is a block, hidden) and ("text", decoded text, words, hidden). A doubtful paragraph's
    name is "p doubtful", which no tag can have. A raw-text element is one tag; ``hidden`` marks what lies inside an element that is never content."""
    out, opened, spans, code = [], defaultdict(list), [], []
    inner: list[tuple[int, str]] = []       # elements in the order they were opened
    endless, at, last = set(), 0, page.rfind(">")
    while m := (TOKEN if at <= last else UNMARKED).match(page, at):
        at = m.end()
        if m["text"] is not None:
            text = htmllib.unescape(m["text"])
            n = len(text.split())
            if text:
                out.append(("text", text, n))
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                if opened[name]:
                    begun, hidden = opened[name].pop()
                    if hidden:
                        spans.append((begun, len(out), name))
                    elif name in CODE:
                        code.append((begun, len(out)))
                    if name in UNSEEN:              # what it leaves open ends with it
                        while inner and inner[-1][0] > begun:
                            i, x = inner.pop()
                            if opened[x] and opened[x][-1][0] == i:
                                opened[x].pop()
                out.append(("tag", "/" + name, name in BLOCKS))
                continue
            closed = m["attrs"].endswith("/") and not _ends_in_value(m["attrs"])
            if name in ENDS and name not in endless and (name in TO_END or not closed):
                end = ENDS[name].search(page, at)
                if end or name in TO_END:
                    at = end.end() if end else len(page)
                    out.append(("tag", name, False))
                    continue
                endless.add(name)
            if name not in VOID and not closed:
                opened[name].append((len(out), hides(name, m["attrs"], bool(opened["article"]))))
                inner.append((len(out), name))
            out.append(("tag", name + " doubtful" if doubtful(name, m["attrs"]) else name, name in BLOCKS))
    listing = _depths(code, len(out))
    spans = [x for x in spans if x[2] in HIDDEN or not listing[x[0]]]
    hiding = _depths(spans, len(out))
    unseen = _depths([x for x in spans if x[2] in UNSEEN], len(out))
    marked = []
    for (kind, key, n), depth, within in zip(out, hiding, unseen):
        marked.append((kind, key, False if within and kind == "tag" else n, depth > 0))
    return marked


def first_weight(key: str, default: float = START) -> float:
    """Weight of a tag kind that no labelled page holds."""
    return DOUBT if key.endswith(" doubtful") else default


def scores(toks, weights: dict[str, float], default: float) -> list[float]:
    out = []
    before = False
    for kind, key, n, hidden in toks:
        if kind == "tag":
            out.append(0.0 if hidden and before else weights[key] if key in weights else first_weight(key, default))
        else:
            out.append(0.0 if hidden else float(n))
        before = hidden
    return out


def best_region(values: list[float]) -> tuple[int, int]:
    """[start, end) of the largest positive sum, the longest of equal ones; (0, 0) if there is none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(values):
        if total < 0:
            total, start = 0.0, i
        total += x
        if total >= best and total > 0:
            best, region = total, (start, i + 1)
    return region


def render(toks) -> str:
    """Text of a region's tokens."""
    blocks, now = [], []
    for kind, key, n, hidden in toks:
        if kind == "tag":
            if n:
                blocks.append(now)
                now = []
            elif key in ("br", "/br") and not hidden:
                now.append(" ")
        elif not hidden:
            now.append(key)
    blocks.append(now)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


class Extractor:
    def __init__(self, weights: dict[str, float] | None = None, default: float = START):
        self.weights, self.default = weights or {}, default

    def extract(self, page: str | None) -> str:
        toks = tokens(page or "")
        a, z = best_region(scores(toks, self.weights, self.default))
        return render(toks[a:z])


def labelled_region(toks) -> tuple[int, int] | None:
    """Tokens inside the only article element of a page that closes it, outer tags left out."""
    opens = [i for i, t in enumerate(toks) if t[0] == "tag" and t[1] == "article"]
    closes = [i for i, t in enumerate(toks) if t[0] == "tag" and t[1] == "/article"]
    if len(opens) != 1 or len(closes) != 1 or closes[0] < opens[0]:
        return None
    inside = [i for i in range(opens[0] + 1, closes[0]) if toks[i][0] == "text" and toks[i][2] and not toks[i][3]]
    return (inside[0], inside[-1] + 1) if inside else None


def fit(pages, epochs: int = EPOCHS) -> Extractor:
    """Tag weights from labelled pages, averaged over the passes; never positive."""
    data = [(t, r) for t in map(tokens, pages) if (r := labelled_region(t))]
    weights = {t[1]: first_weight(t[1]) for toks, _ in data for t in toks if t[0] == "tag"}
    total: dict[str, float] = defaultdict(float)
    for _ in range(epochs):
        for toks, (a, z) in data:
            values = scores(toks, weights, START)
            for i, t in enumerate(toks):         # margin, so that short blocks at the edge count
                if t[0] == "text" and not t[3]:
                    values[i] *= INSIDE if a <= i < z else OUTSIDE
            b, y = best_region(values)
            if (a, z) == (b, y):
                continue
            for i in range(min(a, b), max(z, y)):
                if toks[i][0] == "tag":
                    weights[toks[i][1]] = min(0.0, weights[toks[i][1]] + (a <= i < z) - (b <= i < y))
        for k, w in weights.items():
            total[k] += w
    return Extractor({k: w / epochs for k, w in total.items()})


def labelled_sample(pages: DataFrame, *, url_col="url", html_col="html", labelled_pages: int = LABELLED_PAGES,
                    longest: int = LONGEST) -> DataFrame:
    """Column ``html``: the ``labelled_pages`` different pages (url and html) with the least hashes of those that
    mark one article and have at most ``longest`` characters. Only the hashes are compared between rows."""
    low = F.lower(F.col(html_col))
    once = (F.regexp_count(low, F.lit("<article[\\s>]")) == 1) & (F.regexp_count(low, F.lit("</article\\s*>")) == 1)
    rows = (pages.where(F.length(html_col) <= longest)
            .select(F.xxhash64(url_col, html_col).alias("h"), F.col(html_col).alias("html"), once.alias("once")))
    least = [r.h for r in rows.where("once").select("h").distinct().orderBy("h").limit(labelled_pages).collect()]
    return (rows.where(F.col("h") <= (least[-1] if least else None)).where("once")
            .groupBy("h").agg(F.min("html").alias("html")).orderBy("h").select("html"))


def learn(pages: DataFrame, *, url_col="url", html_col="html", labelled_pages: int = LABELLED_PAGES,
          longest: int = LONGEST) -> Extractor:
    """Extractor fitted on a sample of pages that label their own region (``labelled_sample``)."""
    sample = labelled_sample(pages, url_col=url_col, html_col=html_col, labelled_pages=labelled_pages, longest=longest)
    return fit(r.html for r in sample.collect())


def extract(pages: DataFrame, extractor: Extractor, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(id, url, text, n_chars) per page row."""
    spark = prepare(pages.sparkSession)
    held = spark.sparkContext.broadcast(extractor)     # one number per tag name of the labelled pages

    def run(batches):
        for b in batches:
            texts = [held.value.extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=names)

    rows = pages.select(id_col, url_col, html_col)
    names = [id_col, url_col, "text", "n_chars"]
    schema = rows.select(id_col, url_col).schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema)
