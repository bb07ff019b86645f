"""Sharding, language model and decontamination against brute force."""

import collections
import math
import random
import re
import zlib

import pytest

from shelfmark.llm import contamination as C
from shelfmark.llm import language_model as L
from shelfmark.llm.contamination import Settings, common_subsequence, contamination, without_contamination
from shelfmark.llm.sharding import Rooms, best_fit, even_bins, least_capacity, shard


def test_rooms():
    rng, rooms, plain = random.Random(2), Rooms(), []
    for number in range(300):
        rooms.add(room := rng.randrange(50), number)
        plain.append((room, number))
        if rng.random() < 0.5:
            least = rng.randrange(60)
            want = min((x for x in plain if x[0] >= least), default=None)
            assert rooms.take(least) == want
            if want:
                plain.remove(want)


def test_best_fit_one_by_one():
    rng = random.Random(4)
    for capacity in (100, 137):
        histogram = list(collections.Counter(rng.randrange(1, 90) for _ in range(200)).items())
        runs, bins = best_fit(histogram, capacity)
        free = []
        for size in sorted((s for s, n in histogram for _ in range(n)), reverse=True):
            k = min((k for k in range(len(free)) if free[k] >= size), key=lambda k: (free[k], k), default=None)
            if k is None:
                free.append(capacity)
                k = len(free) - 1
            free[k] -= size
        used = collections.Counter()
        for size, n, number in runs:
            used[number] += size * n
        assert bins == len(free) and sorted(capacity - u for u in used.values()) == sorted(free)
        assert collections.Counter({s: sum(n for z, n, _ in runs if z == s) for s, _ in histogram}) == collections.Counter(dict(histogram))
    assert best_fit([(5, 1)], 4) is None and best_fit([], 4) == ([], 0)
    alone = even_bins([(1000, 1), (3, 40)], 4)
    assert sorted(collections.Counter(n for _, _, n in alone)) == [0, 1, 2, 3] and (1000, 1, 0) in alone
    assert {n: sum(s * g for s, g, m in alone if m == n) for n in range(1, 4)} == {1: 42, 2: 42, 3: 36}
    assert even_bins([], 3) == [] and len(even_bins([(7, 2)], 24)) == 2
    assert least_capacity([(10, 3)], 3) == 10 and least_capacity([(1, 100)], 8) == 13


def check_shards(rows, docs):
    want = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    homes = collections.defaultdict(set)
    for r in rows:
        homes[r.size, r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    return {k: sum(r.size for r in m) for k, m in shards.items()}


def test_shard(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    sizes = check_shards(shard(odd_docs, shards=4).collect(), docs)
    assert set(sizes) <= set(range(4))
    rng = random.Random(9)
    many = [(k, "y" * min(9000, int(rng.paretovariate(1.2) * 40)) + str(k % 1500)) for k in range(2500)]
    sizes = check_shards(shard(spark.createDataFrame(many, "doc_id long, text string"), shards=24).collect(), many)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 0.01 * max(sizes.values())
    capped = check_shards(shard(spark.createDataFrame(many, "doc_id long, text string"), capacity=50000).collect(), many)
    assert max(capped.values()) <= 50000 and len(capped) <= sum(sizes.values()) / 50000 * 1.1 + 1
    with pytest.raises(ValueError):
        shard(spark.createDataFrame(many, "doc_id long, text string"), capacity=1000)
    assert shard(no_docs, shards=24).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


START, END = 0, 1  # no word is a number


def slow_scores(docs, order, mu):
    counts = collections.Counter()
    for d, t in docs:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            w = [START, *words(t), END]
            for n in range(1, order + 1):
                counts.update((tuple(w[k - n + 1: k + 1]) for k in range(max(1, n - 1), len(w))))
            counts[(START,)] += 1
    single = {g: c for g, c in counts.items() if len(g) == 1 and g != (START,)}
    total, types = sum(single.values()), len(single)
    out = []
    for d, t in docs:
        w = [START, *words(t), END]
        base = score = 0.0
        for k in range(1, len(w)):
            p = (counts[(w[k],)] + 0.1) / (total + 0.1 * (types + 1))
            base += math.log10(p)
            for n in range(2, min(order, k + 1) + 1):
                p = (counts[tuple(w[k - n + 1: k + 1])] + mu * p) / (counts[tuple(w[k - n + 1: k])] + mu)
            score += math.log10(p)
        out.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, len(w) - 1, sum(counts[(x,)] > 0 for x in w[1:]), total, round(base, 6), round(score, 6)))
    return collections.Counter(out)


@pytest.mark.parametrize("order,mu,block", [(1, 1.0, 1 << 20), (2, 100.0, 1 << 20), (3, 2.5, 50), (4, 0.7, 1 << 20)])
def test_language_model(odd_docs, order, mu, block):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = L.score_texts(odd_docs, order=order, mu=mu, block=block).collect()
    assert collections.Counter((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == slow_scores(docs, order, mu)


def test_language_model_edges(spark, no_docs):
    assert L.score_texts(no_docs).count() == 0
    held = spark.createDataFrame([(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 10 == 0), "a b")], "doc_id long, text string")
    row = L.score_texts(held).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_language_model_beats_its_root_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = L.score_texts(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert common_subsequence(a, b) == slow_common(a, b)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(12)
    common = ["the", "of", "and", "in", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(4000)}"
    items = {k: [word() for _ in range(rng.choice([12, 20, 40, 59, 150]))] for k in range(30)}
    prose = lambda n: [word() for _ in range(n)]
    docs, want = [], set()
    for k in range(300):
        body = prose(rng.choice([5, 70, 200, 3000]))
        item = k % 30
        at = rng.randrange(len(body) + 1)
        if k < 90:  # copies
            body[at:at] = items[item]
            want.add((k, item))
        elif k < 150:  # a sixth of the words changed, not in the end
            words = list(items[item])
            for j in range(0, len(words) - 5, 6):
                words[j] = f"q{rng.randrange(4000)}"
            body[at:at] = words
            want.add((k, item))
        elif k < 180:  # a short run alone is no leak
            body[at:at] = items[item][:4]
        docs.append((k, " ".join(body).upper() if k % 7 == 0 else "\n".join([" ".join(body)])))
    benchmark = [(k, " ".join(w)) for k, w in items.items()] + [(100, None), (101, ""), (102, "the of")]
    return docs, benchmark, want


@pytest.mark.parametrize("block_words", [1 << 14, 200])
def test_contamination(spark, planted, block_words):
    docs, benchmark, want = planted
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs] + [(900, None, 1, 2), (901, "", 1, 2), (None, benchmark[0][1], 1, 2)], "doc_id long, text string, item_id int, cosine int").repartition(3)
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    settings = Settings(block_words=block_words)
    got = {(r.doc_id, r.item_id) for r in contamination(df, items, settings).collect()}
    assert got == want | {(None, 0)}
    kept = without_contamination(df, items, settings)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*range(300), 900, 901} - {d for d, _ in want})


def test_contamination_of_nothing(spark, planted, no_docs):
    docs, benchmark, _ = planted
    items, df = spark.createDataFrame(benchmark, "item_id long, text string"), spark.createDataFrame(docs[:5], "doc_id long, text string")
    assert contamination(no_docs, items).count() == 0
    assert contamination(df, items.limit(0)).count() == 0
    assert without_contamination(df, items.limit(0)).count() == 5


def test_contamination_recall_against_brute_force(spark):
    """Every benchmark item that stands word for word in a document is found."""
    folder = "/root/testdata/sf0.1"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contamination(docs, items).collect()}
    rows = [(r.doc_id, " " + " ".join(words(r.text)) + " ") for r in docs.collect()]
    passages = [(r.item_id, " " + " ".join(words(r.text)) + " ") for r in items.collect()]
    want = {(d, i) for i, p in passages for d, t in rows if p in t}
    assert len(want) > 50 and want <= got


def test_contamination_of_many_short_items(spark):
    """A benchmark of some thousand short items loses none that a small one finds."""
    rng = random.Random(31)
    word = lambda: f"w{int(1.0008 ** rng.randrange(12000))}"
    items = {k: [word() for _ in range(rng.randint(10, 16))] for k in range(3000)}
    docs = []
    for k in range(0, 3000, 10):
        body = [word() for _ in range(rng.randrange(100, 200))]
        at = rng.randrange(len(body))
        docs.append((k, " ".join([*body[:at], *items[k], *body[at:]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination(df, benchmark).collect()}
    assert {(k, k) for k, _ in docs} <= got


def test_contamination_finds_what_the_verdict_accepts(spark):
    """Short items, whole or in part, are found wherever a stretch of four cells would be accepted."""
    rng = random.Random(32)
    word = lambda: f"w{int(1.0008 ** rng.randrange(12000))}"
    items = {k: [word() for _ in range(rng.choice([5, 6, 7, 9, 12, 16, 40]))] for k in range(200)}
    docs = []
    for k in range(400):
        body, copy = [word() for _ in range(rng.randrange(60, 200))], items[k % 200]
        at = rng.randrange(len(body))
        kept = copy if k < 200 else [w for w in copy if rng.random() < 0.75]
        docs.append((k, " ".join([*body[:at], *kept, *body[at:]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    weights, settings = C.feature_weights(df), Settings()
    [block] = C.prepare(benchmark, weights, settings)
    want = set()
    for k, text in docs:
        hashes = C.words(*C.text_bytes(C.pa.array([text])))[0].view(C.np.int64)
        stretches = [hashes[a: a + 128] for a in range(0, max(1, len(hashes) - 96), 32)]
        here = set(hashes.tolist())
        for p, tokens in enumerate(block.tokens):
            if sum(t in here for t in tokens.tolist()) >= len(tokens) / 2 and any(C.check(block, weights, settings, p, s)[-1] for s in stretches):
                want.add((k, int(block.items[p])))
    assert {(k, k) for k in range(200)} <= want and sum(k % 200 == i for k, i in want) > 290
    assert {(r.doc_id, r.item_id) for r in contamination(df, benchmark).collect()} == want


def test_contamination_gives_one_row_for_an_item_of_several_passes(spark):
    """The passages of a long item may come in different broadcasts; the best of them is its row."""
    rng = random.Random(33)
    item = [f"w{rng.randrange(5000)}" for _ in range(900)]
    df = spark.createDataFrame([(1, " ".join(item)), (None, " ".join(item)), (2, "nothing here")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    rows = contamination(df, benchmark, Settings(block_words=100)).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.common_words) for r in rows) == [(0, 7, 64), (1, 7, 64)]
