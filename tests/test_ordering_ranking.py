import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import ranking
from shelfmark.operators.ordering import global_rank, top_n
from shelfmark.operators.ranking import best_rows


def test_global_rank_with_one_hot_group_and_nulls(spark):
    rows = [(i, "hot" if i % 3 else ("cold" if i % 2 else None), i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = {r["id"]: (r["all"], r["own"]) for r in
           global_rank(global_rank(df, [], ["v", "id"], "all"), ["g"], ["v", "id"], "own").collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    seen = {}
    for place, (i, g, _) in enumerate(order, 1):
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == (place, seen[g])
    assert len(got) == 500


def test_top_n_uses_partial_limits(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    plan = top_n(df, ["g"], [F.col("id")], 3)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 6


def brute(vectors, queries, need, scopes=None, query_scopes=None, bonus=None):
    out = {}
    for q, query in enumerate(queries):
        scored = []
        for i, v in enumerate(vectors):
            if query_scopes and query_scopes[q] is not None and scopes[i] != query_scopes[q]:
                continue
            score = float(np.dot(v, query)) + (bonus[q][i] if bonus else 0.0)
            scored.append((-round(score, ranking.SCORE_DIGITS), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:need[q]]]
    return out


@pytest.mark.parametrize("max_broadcast", [4096, 3])
def test_best_rows_equals_brute_force(spark, max_broadcast):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(200, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[50:60] = vectors[7]                     # equal scores: the lower row index is first
    vectors = vectors.astype(np.float32).astype(float)
    scopes = ["a" if i % 3 else "b" for i in range(200)]
    texts = [("soft mint tea" if i % 4 == 0 else "minty berry") for i in range(200)]
    queries = rng.normal(size=(10, 8))
    queries[0] = vectors[7]
    need = [5, 200, 1, 3, 7, 9, 20, 2, 4, 6]
    wanted = [None, "a", "b", "none", None, "a", None, None, "b", None]
    terms = [["mint"], ["mint", "soft", "tea"], [], ["berry"], ["absent"], ["mint"], ["min", "int"], [], ["tea"], ["mint", "mint"]]
    bonus = [[min(0.12, 0.012 * sum(t in text for t in set(ts))) for text in texts] for ts in terms]
    items = spark.createDataFrame(
        [(i, v.tolist(), s, t) for i, (v, s, t) in enumerate(zip(vectors, scopes, texts))],
        "row_index long, embedding array<float>, scope string, descriptor string").repartition(5)
    asked = spark.createDataFrame(
        [(q, v.tolist(), n, w, t) for q, (v, n, w, t) in enumerate(zip(queries, need, wanted, terms))],
        "query_id long, vector array<double>, need int, scope string, terms array<string>")
    got = {}
    for r in best_rows(items, asked, 8, max_broadcast).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["row_index"], r["score"]))
    expected = brute(vectors, queries, need, scopes, wanted, bonus)
    for q in range(10):
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in expected[q]]
        assert np.allclose([s for _, s in got.get(q, [])], [s for _, s in expected[q]], atol=1e-7)


def test_incomplete_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    items = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [nan, 0.0]), (2, [inf, 0.0]), (3, [0.1, 0.0]), (4, [1.0]), (5, None), (6, [0.0, 1.0])],
        "row_index long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0], 10)], "query_id long, vector array<double>, need int")
    assert [r["row_index"] for r in best_rows(items, asked, 2).orderBy("rank").collect()] == [0, 6]


def test_no_queries_gives_no_rows(spark):
    items = spark.createDataFrame([(0, [1.0])], "row_index long, embedding array<float>")
    asked = spark.createDataFrame([], "query_id long, vector array<double>, need int")
    assert best_rows(items, asked, 1).count() == 0
