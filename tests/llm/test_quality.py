import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import quality as Q
from shelfmark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scores = QUERIES["op10_quality"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = scores.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert len(rows) > 500
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert scores.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def slow_hidden(net, text):
    """Pooled filter responses by plain loops over all bytes."""
    raw = text.encode()
    cells = max(1, -(-len(raw) // Q.CELL))
    raw = raw + bytes((cells + 1) * Q.CELL - len(raw))
    per_cell = []
    for c in range(cells):
        best = [max(sum(net.filters[k][raw[i + k]][f] for k in range(Q.WIDTH)) for i in range(c * Q.CELL, (c + 1) * Q.CELL)) + net.bias[f] for f in range(Q.FILTERS)]
        per_cell.append(best)
    chunks = np.maximum(0, [np.maximum(per_cell[c], per_cell[min(c + 1, cells - 1)]) for c in range(cells)])
    return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])


def test_convolution_covers_the_whole_text():
    rng = np.random.default_rng(1)
    net = Q.train([], np.zeros(0))
    texts = ["", "a", "x" * 31, "y" * 32, "z" * 33, "".join(chr(97 + k) for k in rng.integers(0, 26, 700))]
    layout = Q._layout(*Q.text_bytes(pa.array(texts)))
    got = Q._hidden(net, layout)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, slow_hidden(net, text), atol=1e-4)


def test_score_depends_on_the_text_alone():
    rng = np.random.default_rng(2)
    texts = ["".join(chr(97 + k) for k in rng.integers(0, 26, n)) for n in rng.integers(0, 400, 50)] + [None, "", "w " * 300000]
    net = Q.train(texts[:20] + ["!! " * 9] * 20, np.array([1] * 20 + [0] * 20), epochs=2)
    together = Q.score_texts(net, pa.array(texts))
    alone = [Q.score_texts(net, pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-9)
    assert together[50] == together[51]


def test_gradient_descends():
    good, bad = ["the cat sat on it"] * 30, ["$$$ ### !!!"] * 30
    net = Q.train(good + bad, np.array([1] * 30 + [0] * 30), epochs=60)
    p = Q.score_texts(net, pa.array(["the dog sat", "### $$$"]))
    assert p[0] > 0.8 and p[1] < 0.2


def test_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (6, 0), (None, 1), (9, None), (12, 5)], "doc_id long, quality int")
    net = Q.fit_quality(odd_docs, labels.limit(0))
    scored = Q.score_quality(odd_docs, net)
    assert scored.count() == odd_docs.count() and {r.score for r in scored.collect()} == {0.5}
    assert scored.columns == ["doc_id", "text", "part", "score"]
    assert Q.score_quality(no_docs, Q.fit_quality(odd_docs, labels)).count() == 0


def test_flags_are_never_null(spark, tmp_path):
    docs = [(None, "good words here"), (1, None), (2, "$$$"), (3, ""), (4, "fine words too")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 0), (4, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = QUERIES["op10_quality"](spark, str(tmp_path)).collect()
    assert len(rows) == 5 and all(None not in (r.held_out, r.score, r.predicted) for r in rows)
