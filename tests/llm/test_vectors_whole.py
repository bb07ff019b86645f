"""Centroid clustering and exact search against plain Python on whole numbers."""

import collections
import hashlib
import math

import numpy as np
import pytest

from shelfmark.llm import exact_search as S
from shelfmark.llm.centroid_clusters import cluster
from shelfmark.llm.exact_search import top_k
from shelfmark.llm.integer_vectors import BOUND
from pyspark.sql import functions as F

ODD = [None, [], [None, 1.0, 2.0, 3.0], [math.nan, 1.0, 2.0, 3.0], [math.inf, 1.0, 2.0, 3.0], [1.0, 2.0], [3e38, -3e38, 0.0, 1.0]]


def table(spark, rows, parts=3):
    schema = "vec_id long, embedding array<float>, label int, score string, cluster string, tile long"
    return spark.createDataFrame([(i, v, 0, "x", "y", 1) for i, v in rows], schema).repartition(parts)


def rows_of(n=90, dim=4):
    rng = np.random.default_rng(2)
    rows = [(5 * k, [float(np.float32(x)) for x in rng.normal(size=dim)]) for k in range(n)]
    rows += [(7, rows[0][1]), (7, rows[3][1]), (None, rows[1][1]), (-100, rows[2][1]), (100, rows[5][1])] + [(1000 + k, rows[4][1]) for k in range(30)]
    return rows + [(5000 + k, v) for k, v in enumerate(ODD)]


def whole(v, factor, dim=None):
    if not v or (dim and len(v) != dim) or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [max(-BOUND, min(BOUND, math.floor(factor * float(np.float32(x))))) for x in v]


def slow_clusters(rows, k, rounds, dim, factor):
    kept = [(i, whole(v, factor, dim), [float(np.float32(x)) for x in v or [] if x is not None]) for i, v in rows]
    kept = [r for r in kept if r[1] is not None]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    centroids = [r[1] for r in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v, _ in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if members[j] else c for j, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v, _ in kept]
    per = collections.Counter()
    for _, j, d in found:
        per[j] += d
    most = (1 << 63) - 1
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, j, d, min(per[j], most), min(sum(per.values()), most), texts[j]) for i, j, d in found)


@pytest.mark.parametrize("k,block", [(6, 4096), (40, 16), (500, 7)])
def test_clusters(spark, monkeypatch, k, block):
    monkeypatch.setattr("shelfmark.llm.centroid_clusters.BLOCK", block)
    rows = rows_of()
    got = collections.Counter(map(tuple, cluster(table(spark, rows), k=k, rounds=3, dim=4).collect()))
    assert got == slow_clusters(rows, k, 3, 4, 256)


def slow_search(rows, k, factor):
    kept = [(i, whole(v, factor)) for i, v in rows]
    out = collections.Counter()
    for at, (i, q) in enumerate(kept):
        if q is None or i is None or i % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v)), j is None, j) for other, (j, v) in enumerate(kept) if other != at and v is not None and len(v) == len(q)]
        for rank, (score, _, j) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k]):
            out[i, rank + 1, j, -score] += 1
    return out


@pytest.mark.parametrize("tile,round_bytes,queries,fan", [(8192, 32 << 20, 256, 16), (5, 64, 2, 2)])
def test_search(spark, monkeypatch, tile, round_bytes, queries, fan):
    monkeypatch.setattr(S, "QUERIES", queries)
    monkeypatch.setattr(S, "FAN", fan)
    rows = rows_of()
    got = collections.Counter(map(tuple, top_k(table(spark, rows, 9), F.col("vec_id") % 100 == 0, k=4, tile=tile, round_bytes=round_bytes).collect()))
    assert got == slow_search(rows, 4, 1024)


def test_empty_tables(spark):
    none = table(spark, [])
    assert cluster(none).count() == 0 and top_k(none, F.col("vec_id") % 100 == 0).count() == 0
    odd = table(spark, [(100 * k, v) for k, v in enumerate(ODD[:5])])
    assert cluster(odd, dim=4).count() == 0 and top_k(odd, F.col("vec_id") % 100 == 0).count() == 0
    alone = table(spark, [(0, [1.0, 2.0])])
    assert top_k(alone, F.col("vec_id") % 100 == 0).count() == 0
    assert [tuple(r)[:3] for r in cluster(alone, dim=2).collect()] == [(0, 0, 0)]


def test_scores_beyond_double_precision(spark):
    rows = [(0, [60000.0, 1.0]), (1, [60000.0, 0.001]), (2, [60000.0, 0.002])]
    got = [(r.query_id, r.vec_id, r.score) for r in top_k(table(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 2, 61440000 ** 2 + 2 * 1024), (0, 1, 61440000 ** 2 + 1024)]
