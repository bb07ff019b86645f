"""The term automaton against plain substring tests."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.operators.terms import TermAutomaton

TERM = st.text(alphabet="ab1", min_size=1, max_size=5)


@settings(max_examples=150, deadline=None)
@given(st.lists(TERM, max_size=12, unique=True), st.lists(st.one_of(st.none(), st.text(alphabet="ab1c é", max_size=25)), max_size=12))
def test_hits(terms, texts):
    got = TermAutomaton(terms).hits(pa.array(texts, pa.string()))
    want = [[float(term in (text or "")) for term in terms] for text in texts]
    assert np.array_equal(got, np.array(want, dtype=np.float32).reshape(len(texts), len(terms)))


def test_long_words_and_slices():
    automaton = TermAutomaton(["abc", "bc", "c" * 30])
    texts = pa.array(["x", "zabcz " * 1000, "c" * 100_000, None, "a b c", "abcbc"])
    want = [[0, 0, 0], [1, 1, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0], [1, 1, 0]]
    assert automaton.hits(texts).tolist() == want and automaton.hits(texts.slice(2, 3)).tolist() == want[2:5]
