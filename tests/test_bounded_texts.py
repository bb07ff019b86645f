"""What a Python worker holds beside its texts does not grow with them."""

import tracemalloc

import numpy as np
import pyarrow as pa

from shelfmark.functions import text as X
from shelfmark.operators import ranking as R
from shelfmark.operators.terms import TermAutomaton

TEXTS = pa.array([None, *(f"café & co &amp; <b>w{i % 97}ab</b> " * 200 for i in range(2000)), "", None], pa.string())  # some 13 MB


def peak(work):
    tracemalloc.start()
    try:
        result = work()
        return result, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_parts_of_texts():
    parts = list(X.by_bytes(pa.array(["ab", None, "cdef", "", "g", "h" * 9], pa.string()).slice(1), 5))
    assert [p.to_pylist() for p in parts] == [[None, "cdef", "", "g"], ["h" * 9]]
    assert list(X.by_bytes(pa.array([], pa.string()))) == []


def test_entities_are_decoded_in_pieces():
    for kernel in (X._fold, X._unescape, X._unescape_whole):
        got, most = peak(lambda kernel=kernel: kernel(TEXTS))
        assert most < 8
        some = [0, 1, 500, 2000, 2001, 2002]
        assert got.take(pa.array(some)).to_pylist() == [kernel(TEXTS.slice(i, 1))[0].as_py() for i in some]
        assert len(got) == len(TEXTS) and got.type == TEXTS.type and got.null_count == 2


def test_terms_are_looked_for_in_pieces():
    terms = ["w1", "96ab", "co", "é"]
    got, most = peak(lambda: TermAutomaton(terms).hits(TEXTS))
    assert most < 48
    assert np.array_equal(got, np.array([[float(t in (x or "")) for t in terms] for x in TEXTS.to_pylist()], dtype=np.float32))


def test_terms_are_looked_for_once_in_a_row(monkeypatch):
    rows, asked = 50, 3 * R._QUERY_CHUNK
    looked = []
    hits = TermAutomaton.hits
    monkeypatch.setattr(TermAutomaton, "hits", lambda self, texts: looked.append(len(texts)) or hits(self, texts))
    vectors = pa.array([[1.0, i / 100] for i in range(rows)], pa.list_(pa.float32()))
    batch = pa.record_batch([pa.array(range(rows)), vectors, pa.array([f"w{i}" for i in range(rows)])], names=["row_index", "embedding", "descriptor"])
    queries = pa.table({"query_id": range(asked), "need": [2] * asked, "vector": [[1.0, 0.0]] * asked, "terms": [[f"w{10 + i % 40}"] for i in range(asked)]})
    best = R._Best(R._Queries(queries))
    assert list(best.add(batch)) == [] and sum(looked) == rows
    first = {q: r for part in best.result() for q, r, s in zip(*[column.to_pylist() for column in part.columns]) if s > 1.0}
    assert first == {q: 10 + q % 40 for q in range(asked)}
