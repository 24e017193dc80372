"""URL rules: the fixture site catalogue, one URL per pattern, and random URLs against a
first-match reference written with Python's re (case-insensitive, unanchored)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tabtrail.constants import URL_RULES
from tabtrail.sources.catalog import EXPECTED_CATEGORY, SITES


def first_match(url):
    for name, pats in URL_RULES:
        if any(re.search(p, url, re.IGNORECASE) for p in pats):
            return name
    return None


def classify(spark, urls):
    from pyspark.sql import functions as F
    from tabtrail.functions.rules import category_by_url, with_rule_category
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, url string")
    a = {r.i: r.c for r in with_rule_category(df, "url", "c").collect()}
    b = {r.i: r.c for r in df.select("i", category_by_url(F.col("url")).alias("c")).collect()}
    assert a == b
    return [a[i] for i in range(len(urls))]


def test_site_catalog(spark):
    got = classify(spark, [u for u, _ in SITES])
    assert got == EXPECTED_CATEGORY


def test_traps(spark):
    got = classify(spark, ["https://www.netflix.com/x", "https://dropbox.com/a",
                           "https://github.com/pull", "https://GITHUB.com/a/b/PULL/1",
                           "https://github.com/a/b"])
    assert got == ["Social Connection", "Social Connection", None, "Focused Work", "Research"]


def test_each_pattern_reference(spark):
    urls = []
    for _, pats in URL_RULES:
        for p in pats:
            lit = re.sub(r"\\(.)", r"\1", p.replace(".*", "/x/").replace("(?!.*\\/(pull|issues))", "")
                         .replace("(watch|reels)", "watch").replace("(pull|issues)", "pull"))
            urls.append("https://" + lit + "/page")
    got = classify(spark, urls)
    assert got == [first_match(u) for u in urls]


PIECES = ["github.com/", "a/", "pull", "issues", "YouTube.com/", "watch?v=1", "tutorial",
          "x.com", "netflix.com", "docs.", "reddit.com/r/", "history", "steam", "K", "é", "/"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=6), min_size=20,
                max_size=60))
def test_random_urls_match_reference(spark, many):
    urls = ["https://" + "".join(parts) for parts in many]
    assert classify(spark, urls) == [first_match(u) for u in urls]
