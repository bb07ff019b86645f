"""Entities that were cut off before their semicolon."""

import pytest

import __spark_entry__ as entry
from shelfmark.functions import text as X


@pytest.mark.parametrize("value, browser, whole", [
    ("une&amp", "une&", "une&amp"), ("&amp;lt; &lt;b&gt;x", "&lt; x", "&lt; x"), ("&notit; &#x41;&#66;&#67", "¬it; ABC", "&notit; AB&#67"),
    ("a&nbsp;b &euro;1", "a b €1", "a b €1"), (None, "", "")])
def test_clean_of_whole_entities(one, value, browser, whole):
    assert one(value, X.clean) == browser
    assert one(value, lambda t: X.clean(t, whole_only=True)) == whole


def test_clean_html_leaves_a_cut_entity(spark, tmp_path):
    spark.createDataFrame([(1, "<h1>und&&&amp</h1>x &amp; y")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert entry.queries()["clean_html"](spark, str(tmp_path)).collect() == [(1, "und&&&amp\nx & y")]
