"""The automaton against regular expressions, and the query's rules against plain string tests."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.arrays import text_bytes
from shelfmark.llm.queries import RULES
from shelfmark.llm.url_filter import Automaton, Rule, judge_urls, split_url


def pattern(glob):
    parts = re.findall(r"\*\*|\*|\?|[^*?]+", glob)
    return re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts).encode(), re.S)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab/.*?", max_size=9), min_size=1, max_size=30), st.lists(st.text(alphabet="ab/.é", max_size=12), max_size=12))
def test_automaton(globs, texts):
    found = Automaton(globs).matches(*text_bytes(pa.array(texts, pa.string())))
    want = np.array([[bool(pattern(g).fullmatch(t.encode())) for g in globs] for t in texts]).reshape(len(texts), len(globs))
    assert np.array_equal(found, want)


URLS = [None, "", "x", "://", "http://", "http://Example.ORG/es/1", "http://example.org/es", "http://m.example.org/en/1?x#y", "http://notexample.org/es/",
        "https://a.com/de/1", "https://a.com/fr/", "https://a.com?/de/", "https://com/de/", "ftp://b.net/x#/de/", "http://evil.net/x.example.org/es/",
        "http://example.org/es/1", "http://a.com/de/" + "x" * 5000, "http://a.com/DE/"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_rules(spark):
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, RULES).collect()}
    assert got == {k: plain(u) for k, u in enumerate(URLS)}


def test_wildcards_ties_and_nothing(spark):
    pages = spark.createDataFrame([(1, "http://shop1.example.org/a/b/login"), (2, "http://shop22.example.org/a/login")], "page_id long, url string")
    rules = [Rule("block", "shop?.example.org", "/*/login"), Rule("block", "shop*.example.org", "/**/login")]
    assert [r.rule for r in judge_urls(pages, rules).orderBy("page_id").collect()] == ["shop*.example.org/**/login"] * 2
    assert [r.rule for r in judge_urls(pages, rules[:1]).orderBy("page_id").collect()] == [None, None]
    same = [Rule("block", "org", "/a"), Rule("allow", "org", "/?")]
    assert judge_urls(pages, same).select("verdict").distinct().collect()[0].verdict == "block"
    assert {r.verdict for r in judge_urls(pages, [], default="block").collect()} == {"block"}
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_split_url_of_any_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("http://A.Example.org/p?q",), (None,), ("no",), ("x://h#f",)], "link string")
    assert [tuple(r) for r in df.select(*split_url(F.col("link"))).collect()] == [("a.example.org", "/p"), ("", ""), ("", ""), ("h", "")]


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "http://a.org/"), (None, "http://a.org/"), (1, None), (1, None)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [Rule("block", "org", "/")]).collect()
    assert sorted((str(r.page_id), r.rule, r.verdict) for r in got if r.rule) == [("None", "org/", "block")] * 2
    assert [(r.page_id, r.host, r.verdict) for r in got if not r.rule] == [(1, "", "allow")] * 2
