import html
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import text as X


@pytest.mark.parametrize("value, expected", [
    ("Café &amp; Thé <b>x</b> ﬁn", "cafe and the x fin"),
    ("caf&eacute; M&M", "caf m and m"),          # entities decode after accents are gone
    ("K ſ ½ ①", "k s 1 2 1"),
    ("&lt;b&gt;", "b"),                            # tags go before entities decode
    ("", ""), (None, ""), ("  --  ", ""),
])
def test_normalize(one, value, expected):
    assert one(value, X.normalize) == expected


def test_normalize_each_equals_normalize(spark):
    words = ["Ünï", "a&b", None, "plain", "x<br>y"]
    df = spark.createDataFrame([(words,), (None,), ([],)], "t array<string>")
    got = [r["r"] for r in df.select(X.normalize_each(F.col("t")).alias("r")).collect()]
    assert got == [["uni", "a and b", "", "plain", "x y"], None, []]


@pytest.mark.parametrize("value, expected", [
    ("A<br/>B</p>  c&nbsp;d", "A\nB\n c d"),
    ("&lt;b&gt;x&lt;/b&gt;", "x"),                 # entities decode before tags go
    ("a\n\n \n\nb", "a\nb"),
    ("  a \x1c", "a"),
    ("Good stuff. WARNING: do not", "Good stuff."),
    ("Warning: first\nlast", "Warning: first\nlast"),   # only the last line is cut
    ("one\nLicensed dispensary 1\nKeep out of reach of children. x", "one"),   # phrases are tried once, in order
    ("one\nKeep out of reach of children. x\nLicensed dispensary 1", "one\nKeep out of reach of children. x"),
    ("Forewarning: stays", "Forewarning: stays"),
    ("foo\nWarning:\nbar", "foo"),                      # white space after the colon may hold a line break
    (None, ""),
])
def test_clean(one, value, expected):
    assert one(value, X.clean) == expected


@pytest.mark.parametrize("value, expected", [
    ("Happy, Calm;happy| None /N/A", ["Happy", "Calm", "N", "A"]),   # a slash splits n/a
    ("a &amp; b", ["a &", "b"]),                   # the entity's semicolon splits
    ("Café, cafe: , .x.", ["Café", "x"]),
    ("", []), (None, []),
])
def test_split_terms(one, value, expected):
    assert one(value, X.split_terms) == expected


def test_split_terms_of_list_drops_empty_words(one):
    assert one(["N/A", "None", "Mint"], X.split_terms_of, "array<string>") == ["Mint"]


def test_labelled_section(one):
    text = "x EFFECT PROFILE: Happy,\nCalm. Flavor Profile : a|b LINEAGE:"
    assert one(text, lambda t: X.labelled_section(t, "EFFECT PROFILE")) == "Happy,\nCalm"
    assert one(text, lambda t: X.labelled_section(t, "FLAVOR PROFILE")) == "a|b"
    assert one(text, lambda t: X.labelled_section(t, "LINEAGE")) == ""
    assert one(text, lambda t: X.labelled_section(t, "AROMA")) == ""


@pytest.mark.parametrize("value, expected", [
    ("Give me the clean high", "clean high clear headed focused mentally crisp functional balanced uplifted minimal fog"),
    ("find me give me a pen", "give me pen"),      # one prefix only
    ("Something for sleep", "sleep"),              # the prefix takes the "for" of "for sleep"
    ("tea for sleep, not sleepy", "tea for sleep not sleepy alert awake functional minimal sedation "
                                  "sleepy deeply relaxed body relaxation nighttime"),
    ("", ""),
])
def test_expand_intent(one, value, expected):
    assert one(value, X.expand_intent) == expected


def test_meaningful_terms(one):
    assert one("Give me THE best weed of my day, ok", X.meaningful_terms) == ["best", "day"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_normalize_is_idempotent_and_matches_unicode_rules(spark, values):
    import re

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    once = df.select("i", X.normalize(F.col("t")).alias("t"))
    twice = once.select("i", X.normalize(F.col("t")).alias("t"))
    got = dict(once.collect())
    assert got == dict(twice.collect())
    for i, value in enumerate(values):
        bare = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
        plain = html.unescape(re.sub("<[^>]+>", " ", bare)).lower().replace("&", " and ")
        assert got[i] == " ".join(re.findall("[a-z0-9]+", plain))
