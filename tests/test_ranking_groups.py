"""Ranking of many queries: equal ones once, long lists in pieces, single precision only as a filter."""

import numpy as np
import pytest

from shelfmark.operators import ranking

ITEMS = "row_index long, embedding array<float>, scope string"
QUERIES = "query_id long, vector array<double>, need int, scope string"


def exact(vectors, scopes, queries):
    out = []
    for q, vector, need, scope in queries:
        scored = sorted((-round(float(np.dot(v, vector)), ranking.SCORE_DIGITS), i) for i, v in enumerate(vectors) if scope in (None, scopes[i]))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:need], 1)]
    return out


@pytest.mark.parametrize("held", [ranking._HELD, 40])
@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e20])
def test_groups_and_pieces(spark, monkeypatch, held, scale):
    monkeypatch.setattr(ranking, "_HELD", held)
    monkeypatch.setattr(ranking, "_ROWS", 37)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 6))
    vectors = np.concatenate([base, base[:60] + 1e-8 * rng.normal(size=(60, 6)), base[:40]]).astype(np.float32).astype(float)
    scopes = [("a", "b")[i % 2] for i in range(len(vectors))]
    told = (base[:7] * scale).tolist()
    queries = [(q, told[q % 7], (3, 90, 20)[q % 3], (None, "a", "b", "none")[q % 4]) for q in range(60)]
    items = spark.createDataFrame([(i, v.tolist(), s) for i, (v, s) in enumerate(zip(vectors, scopes))], ITEMS).repartition(3)
    got = ranking.best_rows(items, spark.createDataFrame(queries, QUERIES), 6, 5).orderBy("query_id", "rank").collect()
    if scale > 1:  # sums of such size differ by their order
        got, wanted = [(r["query_id"], r["rank"]) for r in got], [w[:2] for w in exact(vectors, scopes, queries)]
        assert got == wanted
        return
    assert [(r["query_id"], r["rank"], r["row_index"]) for r in got] == [w[:3] for w in exact(vectors, scopes, queries)]


def test_equal_queries_are_ranked_once(spark, monkeypatch):
    blocks = []
    score = ranking._score_broadcast
    monkeypatch.setattr(ranking, "_score_broadcast", lambda items, head: blocks.append(head.num_rows) or score(items, head))
    items = spark.createDataFrame([(i, [float(i), 1.0], "a") for i in range(9)], ITEMS)
    queries = spark.range(5000).selectExpr("id AS query_id", "array(double(id % 3), 1D) AS vector", "int(1 + id % 2) AS need", "string(null) AS scope")
    got = ranking.best_rows(items, queries, 2)
    assert blocks == [3]
    assert got.count() == 7500 and got.where("rank > 2").isEmpty()


def test_lists_of_deep_pages_are_handed_on():
    import pyarrow as pa

    head = pa.table({"query_id": [1, 2], "need": [100_000, 100_000], "vector": [[1.0, 0.0], [0.0, 1.0]]})
    best, given = ranking._Best(ranking._Queries(head)), 0
    batch = pa.record_batch({"row_index": pa.array(range(300_000), pa.int64()), "embedding": pa.array([[float(i % 7), 1.0] for i in range(300_000)])})
    ranking._HELD, kept = 50_000, ranking._HELD
    try:
        for part in best.add(batch):
            given += part.num_rows
            assert part.num_rows <= 120_000
        assert best.held <= 50_000 + 4 * ranking._ROWS and given >= 200_000
    finally:
        ranking._HELD = kept
