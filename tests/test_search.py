"""Search against a brute-force model written from the service's rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark import vocabulary as V
from shelfmark.functions import text as X
from shelfmark.operators import embedding as E
from shelfmark.operators import index as I
from shelfmark.operators import search as S
from shelfmark.schema import INVENTORY, REQUEST

DIM = 16
MODEL = E.hashing_model(DIM)
NAMES = ["Blue Dream", "Blue Cheese", "Og", "Lemon Haze", "Dream Catcher", "Blue Dream", "Tea", "Mint Tea"]
BRANDS = ["Raw", "Blue Co", "Raw"]
CATEGORIES = ["Flower", "Vape Pen", "", "flower"]
WORDS = "calm focus happy berry citrus pine earthy sleepy social body".split()
REQUESTS = [
    ("", "all", 0, 0), ("  ", "All", 2, 3), ("", "flower", 1, 2), ("", "nope", 0, 5), ("", None, -4, 1000),
    ("blue dream", "all", 0, None), ("Blue", "all", 0, 3), ("blue", "FLOWER", 0, 24), ("ea", "all", 0, 24), ("og", "all", 0, 24),
    ("zzz", "all", 0, 24), ("raw", "vape pen", 1, 2), ("dream", "All", 0, 24),
    ("calm", "all", 0, 4), ("give me a calm social evening", "all", 0, -1), ("happy body for sleep please", "flower", 3, 5),
    ("berry and citrus notes, not sleepy", "nope", 0, 5), ("no anxiety clean high", "cannabis", 0, 50),
]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(60):
        row = {f.name: None for f in INVENTORY.fields}
        row.update(row_index=i, id=f"r{i:02d}", name=NAMES[i % len(NAMES)], brand=BRANDS[i % 3], category=CATEGORIES[i % 4],
                   strain=NAMES[(i + 3) % len(NAMES)] if i % 5 == 0 else "", subcategory="", form="", strain_type="hybrid",
                   phenotype="", lineage="", description=" ".join(rng.choice(WORDS, 4)), effects=[str(rng.choice(WORDS))], flavors=[])
        out.append(row)
    return out


@pytest.fixture(scope="module")
def index(spark, rows):
    inventory = spark.createDataFrame([tuple(r[n] for n in INVENTORY.names) for r in rows], INVENTORY)
    embed = E.embedder(MODEL, DIM)
    vectors = embed(inventory.select("id", "description"), "description", "embedding")
    return I.with_vectors(I.with_browse_ranks(I.search_index(inventory)), vectors).cache()


def norm(text):
    return " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in (text or "").lower().replace("&", " and ")).split())


def expected(rows, request, canonical):
    q, category, offset, limit = request
    q, category = q.strip(), category or "all"
    offset, limit = max(0, offset), min(100, max(1, limit or 24))
    scopes = [norm(r["category"] or "Cannabis") for r in rows]
    everything = range(len(rows))
    own = [i for i in everything if scopes[i] == norm(category)]
    key = {i: (rows[i]["category"], rows[i]["brand"], rows[i]["name"]) for i in everything}
    if not q:
        order = sorted(own, key=lambda i: key[i][1:]) if own else sorted(everything, key=lambda i: key[i])
        return "browse", len(order), [(rows[i]["id"], None) for i in order[offset:offset + limit]]
    pool = list(everything) if category == "all" else own
    phrase = norm(q)
    values = [[norm(r[f]) for f in ("name", "brand", "strain")] for r in rows]
    terms = {w for w in phrase.split() if len(w) >= 3 and w not in V.STOPWORDS}
    if any(phrase in v for v in values) or (len(phrase.split()) <= 3 and not terms & set(V.INTENT_WORDS) and len(phrase) >= 3):
        weight = {i: max((4 if v == phrase else 3 if v.startswith(phrase) else 2 if phrase in v else 0) for v in values[i]) for i in pool}
        order = sorted((i for i in pool if weight[i]), key=lambda i: (-weight[i], *key[i][1:]))
        return "identity", len(order), [(rows[i]["id"], None) for i in order[offset:offset + limit]]
    wanted = {w for w in norm(canonical).split() if len(w) >= 3 and w not in V.STOPWORDS}
    query = MODEL([canonical])[0]
    query /= np.linalg.norm(query)
    scores = {}
    for i in pool:
        vector = MODEL([rows[i]["description"]])[0]
        vector = (vector / np.linalg.norm(vector)).astype(np.float32).astype(float)
        r = rows[i]
        descriptor = norm(" ".join([r["category"], "hybrid", r["description"], *r["effects"]]))
        scores[i] = round(float(vector @ query.astype(np.float32)) + min(0.12, 0.012 * sum(w in descriptor for w in wanted)), 7)
    order = sorted(pool, key=lambda i: (-scores[i], i))
    return "outcome", len(order), [(rows[i]["id"], scores[i]) for i in order[offset:offset + limit]]


def test_search_equals_brute_force(spark, rows, index):
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(REQUESTS)], REQUEST)
    canonical = {r["query_id"]: r["t"] for r in requests.select("query_id", X.canonical_query(F.col("q")).alias("t")).collect()}
    got = {}
    for r in S.search(requests, index, E.embedder(MODEL, DIM), DIM).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    modes = set()
    for i, request in enumerate(REQUESTS):
        mode, total, page = expected(rows, request, canonical[i])
        mine = got.get(i, [])
        assert {(r["query_mode"], r["total"], r["query_text"]) for r in mine} == {(mode, total, canonical[i] if mode == "outcome" else None)}, request
        mine = [r for r in mine if r["rank"] is not None]
        assert [r["id"] for r in mine] == [p[0] for p in page], request
        for r, (_, score) in zip(mine, page):
            assert r["score"] is None if score is None else abs(r["score"] - score) < 2e-6
        modes.add(mode)
    assert modes == {"browse", "identity", "outcome"}


def test_totals_cover_requests_without_results(spark, index):
    requests = spark.createDataFrame([(1, "zzz", "all", 0, 1), (2, "calm evening at home", "nope", 0, 1)], REQUEST)
    routed = S.route(S.prepare_requests(requests), index)
    identity = S.identity_matches(routed.filter("query_mode = 'identity'"), index)
    got = {r["query_id"]: (r["query_mode"], r["total"]) for r in S.totals(routed, index, identity).collect()}
    assert got == {1: ("identity", 0), 2: ("outcome", 0)}


def test_semantic_search(spark):
    vectors = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [0.6, 0.8]]
    rows = spark.createDataFrame([(i, f"r{i}", "Tea" if i else "Box ", v) for i, v in enumerate(vectors)],
                                 "row_index long, id string, category_label string, embedding array<float>")

    def embed(df, text, vector):
        return df.withColumn(vector, F.array(F.lit(0.0), F.lit(2.0)))

    requests = spark.createDataFrame(
        [(1, "x", "ALL", 0, 0), (2, "x", " tea ", 1, 1), (3, "", "TEA", 0, 2), (4, "", None, 3, 999), (5, "x", "box", 0, 5)], REQUEST)
    got = {}
    for r in S.semantic_search(requests, rows, embed, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["total"], r["score"]))
    assert [g[0] for g in got[1]] == ["r1", "r2", "r3", "r0"] and got[1][0][2] == 1.0
    assert got[2] == [("r2", 3, 0.8)] or abs(got[2][0][2] - 0.8) < 1e-6
    assert got[3] == [("r1", 3, None), ("r2", 3, None)]
    assert got[4] == [("r3", 4, None)]
    assert got[5] == [(None, 0, None)]                # the row's own category is not trimmed
