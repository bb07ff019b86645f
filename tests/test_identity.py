"""Identity search over posting lists against its plain form, request aliases and category rules."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import index as I
from shelfmark.operators import search as S
from shelfmark.operators.ordering import top_n


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(5)
    words = ["tea", "mint", "blue", "a", "ab", "abc", "dream"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
    rows = []
    for k in range(400):
        shared = name()
        brand = "mint house" if rng.random() < 0.6 else rng.choice([shared, name()])     # one value has most rows
        rows.append((k, f"r{k:03d}", brand, shared, rng.choice(["flower", "box", ""]), [shared, brand, rng.choice(["", shared, name()])]))
    return spark.createDataFrame(rows, "row_index long, id string, brand string, name string, scope string, identity array<string>").repartition(5).cache()


def requests_of(spark, rows):
    return spark.createDataFrame(rows, "query_id long, phrase string, scope string, offset int, limit int").withColumn("need", F.col("offset") + F.col("limit"))


@pytest.mark.parametrize("most", [(0, 1), (0, 5), (3, 4), (100, 40)])
def test_pages_and_totals_equal_the_plain_form(spark, index, most):
    offset, limit = most
    phrases = ["tea", "mint", "a", "ab", "mint house", "house", "blue dream", "zzz", "", "e", "t b", "dream abc"]
    asked = requests_of(spark, [(10 * i + j, p, s, offset if j else 0, limit) for i, p in enumerate(phrases) for j, s in enumerate(["*", "flower", "nope", "*"])])
    matches = S.identity_matches(asked.filter("phrase <> ''"), index)
    order = [F.desc("weight"), F.asc("brand"), F.asc("name"), F.asc("row_index")]
    plain = S._cut(top_n(matches, ["query_id"], order, 1000), asked)
    hits = S.phrase_matches(asked.select("phrase").filter("phrase <> ''").distinct(), I.identity_values(index)).cache()
    pages = S.identity_pages(asked, hits, index)
    shown = ["query_id", "rank", "row_index", "id", "weight"]
    assert sorted(map(tuple, pages.select(*shown).collect())) == sorted(map(tuple, plain.select(*shown).collect()))
    found = {r["query_id"]: r["found"] for r in S.identity_totals(asked, hits, index).collect()}
    assert found == {r["query_id"]: r["count"] for r in matches.groupBy("query_id").count().collect()}


def test_a_frequent_value_sends_few_rows(spark, index):
    asked = requests_of(spark, [(1, "mint house", "*", 0, 3)])
    hits = S.phrase_matches(asked.select("phrase"), I.identity_values(index)).cache()
    lists = S._posting_lists(index, hits, 3)
    assert lists.groupBy("value", "place").count().agg(F.max("count")).first()[0] == 3
    assert index.filter(F.array_contains("identity", "mint house")).count() > 200


def test_request_aliases(spark):
    one = S.prepare_requests(spark.createDataFrame([(1, "x", None, "Tea", 0, 0), (2, "x", "", "Tea", 0, 5), (3, "x", "Box", "Tea", 0, 5), (4, "x", None, None, 0, 5)],
                                                   "query_id long, q string, category string, type string, offset int, limit int"))
    assert [(r["category"], r["limit"]) for r in one.orderBy("query_id").collect()] == [("Tea", 24), ("Tea", 5), ("Box", 5), ("all", 5)]
    rows = spark.createDataFrame([(i, f"r{i}", "Tea " if i % 2 else "box", [1.0, float(i)]) for i in range(6)],
                                 "row_index long, id string, category_label string, embedding array<double>")
    schema = "query_id long, q string, query string, text string, type string, offset int, limit int, k int"
    asked = spark.createDataFrame([(1, None, "x", "", "TEA", 0, 0, 2), (2, "", None, " y ", "tea", 0, 1, 9), (3, "", "", "", " Box ", 0, None, None)], schema)

    def embed(df, text, vector):
        return df.withColumn(vector, F.array(F.lit(0.0), F.lit(1.0)))

    for browser, tea in ((False, []), (True, ["r5", "r3"])):
        got = {}
        for r in S.semantic_search(asked, rows, embed, 2, browser=browser).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {1: tea or [None], 2: tea[:1] or [None], 3: ["r0", "r2", "r4"]}
