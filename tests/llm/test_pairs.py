"""Near duplicates, metric join and components against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from shelfmark.llm import near_duplicates as N
from shelfmark.llm.components import components
from shelfmark.llm.metric_join import range_join
from shelfmark.llm.near_duplicates import near_duplicates


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {"path": [(k, k + 1) for k in range(40)], "star": [(0, k) for k in range(1, 40)] + [(3, 3), (None, 4)],
             "random": [(rng.randrange(100), rng.randrange(100)) for _ in range(60)], "none": []}[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots({n for link in real for n in link}, real)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_texts():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 9, 30, 120]))] for _ in range(25)]
    texts = []
    for base in bases:
        for _ in range(rng.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append((" " if rng.random() < 0.5 else "\n").join(words))
    return [*texts, None, "", " \t", "one", "ONE", "one two three", "one  two\vthree", texts[0].upper(), *[texts[3]] * 30]


@pytest.mark.parametrize("cell", [2, 256])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL", cell)
    texts = near_texts()
    docs = spark.createDataFrame([(7 * k + 1, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, set_key string, n long").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    sets = {7 * k + 1: shingles(t) for k, t in enumerate(texts)}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_near_duplicates_edges(spark, no_docs):
    assert near_duplicates(no_docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "x"), (1, "x"), (2, "x"), (3, None)], "doc_id long, text string")
    got = collections.Counter(map(tuple, near_duplicates(docs).collect()))
    assert got == {(None, 2, None, False): 1, (1, 2, 1, True): 1, (1, 1, 1, True): 2, (2, 1, 1, False): 1, (3, 0, 3, True): 1}


def test_least_matches_keep_alike_pairs():
    rng = np.random.default_rng(3)
    for similarity in (0.75, 0.9):
        a = rng.integers(0, 256, (20000, N.SKETCH), dtype=np.uint8)
        b = np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
        assert len(N.likely(a, b, 0.75, 1e-4)[0]) >= 20000 * 0.999
    assert len(N.likely(a, rng.integers(0, 256, a.shape, dtype=np.uint8), 0.75, 1e-4)[0]) == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for common in (100, 200, 300):
        b = np.concatenate([a[:common], rng.integers(0, 1 << 63, 400 - common, dtype=np.uint64)])
        s = N.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 400, 800]))
        assert abs((s[0] == s[1]).mean() - common / (800 - common)) < 0.13


def vectors(dim=12):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, dim))
    rows = [b + 0.12 * rng.normal(size=dim) for b in base for _ in range(rng.integers(1, 9))]
    rows += [rows[0]] * 20 + [rows[1] * 3, rows[2] * 1e200, rows[3] * 1e-200]
    out = [list(map(float, r)) for r in rows]
    odd = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [float("inf")] * dim, [1.0, 0.0], [2.0, 0.0]]
    return out + odd


@pytest.mark.parametrize("target,block,lot", [(8192, 4096, 16384), (20, 7, 9), (5, 3, 1000)])
def test_range_join(spark, target, block, lot):
    rows = vectors()
    df = spark.createDataFrame([(5 * k, r, 1, 2) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, unit int, copies int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join(df, target=target, block=block, lot=lot).collect()}
    good = {5 * k: np.array(r) / max(abs(x) for x in r) for k, r in enumerate(rows) if r and all(x is not None and np.isfinite(x) for x in r) and any(r)}
    unit = {k: v / np.linalg.norm(v) for k, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    assert len(links) > 100
    degree = collections.Counter(x for link in links for x in link)
    want = roots([5 * k for k in range(len(rows))], links)
    assert got == {i: (degree[i], want[i], want[i] == i) for i in want}


def test_range_join_edges(spark):
    assert range_join(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, range_join(only).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    same = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, range_join(same).collect()), key=str) == [(4, 2, 4, True), (4, 2, 4, True), (None, 2, None, False)]
