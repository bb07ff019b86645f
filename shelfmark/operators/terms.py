"""VEC-4: which of many terms occur in which texts, by one automaton over the bytes of a batch."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfmark.functions.text import by_bytes


class TermAutomaton:
    """A trie of terms with failure links, as tables: one step takes one byte of every word.

    Terms hold no spaces, so a term lies inside one word.  Each distinct word of a batch is scanned once, all
    of them in step, and the texts take over what their words hold.
    """

    def __init__(self, terms: list[str]):
        self.count = len(terms)
        raw = [term.encode() for term in terms]
        used = sorted({byte for term in raw for byte in term})
        self.code = np.zeros(256, dtype=np.int64)  # 0: a byte of no term
        self.code[used] = np.arange(1, len(used) + 1)
        steps: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for number, term in enumerate(raw):
            state = 0
            for byte in term:
                code = int(self.code[byte])
                if code not in steps[state]:
                    steps.append({})
                    own.append([])
                    steps[state][code] = len(steps) - 1
                state = steps[state][code]
            if term:
                own[state].append(number)
        self.next = np.zeros((len(steps), len(used) + 1), dtype=np.int32)
        failure, found = [0] * len(steps), [list(o) for o in own]
        waiting = deque()
        for code, state in steps[0].items():
            self.next[0, code] = state
            waiting.append(state)
        while waiting:  # by depth: a failure link leads to a shorter state, whose row is ready
            state = waiting.popleft()
            self.next[state] = self.next[failure[state]]
            found[state] += found[failure[state]]
            for code, after in steps[state].items():
                failure[after] = int(self.next[failure[state], code])
                self.next[state, code] = after
                waiting.append(after)
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        self.first, self.sizes = np.cumsum(sizes) - sizes, sizes
        self.found = np.array([n for f in found for n in f], dtype=np.int64)

    def scan(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(word, term)`` of words and the terms inside them; a pair may stand more than once."""
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset: words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")  # longest first: those still running are a prefix
        at, lengths = offsets[:-1][order], lengths[order]
        state = np.zeros(len(order), dtype=np.int64)
        hit_word, hit_state = [], []
        for step in range(int(lengths[0]) if len(lengths) else 0):
            running = int(np.searchsorted(-lengths, -step))  # lengths > step
            state[:running] = self.next[state[:running], self.code[data[at[:running] + step]]]
            hits = np.flatnonzero(self.sizes[state[:running]])
            hit_word.append(order[hits])
            hit_state.append(state[hits])
        if not hit_word:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        word, last = np.concatenate(hit_word), np.concatenate(hit_state)
        sizes = self.sizes[last]
        ends = np.cumsum(sizes)
        place = np.repeat(self.first[last] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.repeat(word, sizes), self.found[place]

    def hits(self, texts: pa.Array) -> np.ndarray:
        """Texts x terms, 1 where the term occurs; a null text holds none.

        Words and their hits are held for about ``PIECE`` bytes of text at a time.
        """
        out, first = np.zeros((len(texts), self.count), dtype=np.float32), 0
        for part in by_bytes(texts):
            self._mark(part, out[first: first + len(part)])
            first += len(part)
        return out

    def _mark(self, texts: pa.Array, out: np.ndarray) -> None:
        lists = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
        coded = lists.flatten().dictionary_encode()
        word, term = self.scan(coded.dictionary)
        if not len(word):
            return
        pairs = np.unique(word * self.count + term)
        word, term = pairs // self.count, pairs % self.count
        codes = coded.indices.to_numpy()
        rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        first, last = np.searchsorted(word, codes), np.searchsorted(word, codes, side="right")
        sizes = last - first
        ends = np.cumsum(sizes)
        place = np.repeat(first - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        out[np.repeat(rows, sizes), term[place]] = 1.0
