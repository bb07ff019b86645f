"""URL rules with wildcards as one bit-parallel automaton.

A rule is a glob over the canonical form ``.host path`` of a URL (the space ends the host, and a
path begins with a slash if it is not empty): ``*`` stands for any run of
bytes without a slash, ``**`` for any run, ``?`` for one byte other than a slash.  All rules are
laid one after another in the bits of a Shift-And state of as many 64-bit words as they need.
One step per byte of the URL moves every rule at once, and a task steps all URLs of a batch
together, so the work is bytes of URL times words of state, whatever the rules are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ONE = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs of ``host`` and its subdomains whose path starts with ``path``; both may hold wildcards."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host} {self.path}**"


class Automaton:
    """Shift-And masks of a list of globs.

    State bit k of a glob means: its first k items match what was read.  A wildcard is a self-loop on
    the state before it; with its own empty match this is the epsilon-free form of the glob.
    """

    def __init__(self, globs: Sequence[str]):
        starts, loops_any, loops_name, steps, self.last = [], [], [], [], []
        bit = 0
        for glob in globs:
            starts.append(bit)
            k = 0
            raw = glob.encode()
            while k < len(raw):
                if raw[k:k + 2] == b"**":
                    loops_any.append(bit)
                    k += 2
                elif raw[k:k + 1] == b"*":
                    loops_name.append(bit)
                    k += 1
                else:
                    bit += 1
                    steps.append((bit, None if raw[k:k + 1] == b"?" else raw[k]))
                    k += 1
            self.last.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))

        def mask(bits) -> np.ndarray:
            out = np.zeros(self.words, dtype=np.uint64)
            for b in bits:
                out[b // 64] |= _ONE << np.uint64(b % 64)
            return out

        self.start, any_loop, name_loop = mask(starts), mask(loops_any), mask(loops_name)
        self.enter = np.zeros((256, self.words), dtype=np.uint64)  # states that a byte leads into from the state below
        self.stay = np.tile(any_loop | name_loop, (256, 1))  # states that a byte leaves standing
        self.stay[ord("/")] = any_loop
        for b, byte in steps:
            for value in range(256) if byte is None else [byte]:
                if byte is not None or value != ord("/"):
                    self.enter[value, b // 64] |= _ONE << np.uint64(b % 64)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of booleans per text, one per glob: does the glob match the whole text?"""
        n = len(offsets) - 1
        order = np.argsort(-np.diff(offsets), kind="stable")  # longest first: the texts still running are a prefix
        at, lengths = offsets[:-1][order], np.diff(offsets)[order]
        state = np.tile(self.start, (n, 1))
        step, running = 0, int(np.count_nonzero(lengths > 0))
        while running:
            bytes_now = data[at[:running] + step]
            now = state[:running]
            shifted = now << _ONE
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:running] = (shifted & self.enter[bytes_now]) | (now & self.stay[bytes_now])
            step += 1
            running = int(np.searchsorted(-lengths[:running], -step))  # lengths > step
        found = np.zeros((n, len(self.last)), dtype=bool)
        for g, bit in enumerate(self.last):
            found[order, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & _ONE
        return found


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def judge_urls(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages``.

    The longest rule that fits decides (of equals the first in the list); without one, ``rule`` is null
    and ``verdict`` is ``default``.  A null URL, and one without ``://``, has an empty host and path and
    fits no rule with a host.  Rows are judged each, repeated or not; other columns play no part; an
    empty list of rules fits nothing; no rows give no rows.
    """
    automaton = Automaton([rule.glob for rule in rules])
    ranked = sorted(range(len(rules)), key=lambda k: -len(rules[k].name))
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("__url"))
    host, path = split_url(F.col("__url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))

    def judge(batches):
        from shelfmark.llm.arrays import slices, text_bytes
        import pyarrow.compute as pc

        names = pa.array([rule.name for rule in rules], pa.string())
        verdicts = pa.array([*(rule.verdict for rule in rules), default], pa.string())
        for batch in batches:
            text = pc.binary_join_element_wise(pc.binary_join_element_wise(pa.scalar(""), batch.column("host"), "."), batch.column("path"), " ")
            for part in slices(pa.RecordBatch.from_arrays([*batch.columns, text], ["page_id", "host", "path", "text"]), "text", 1 << 20):
                found = automaton.matches(*text_bytes(part.column("text")))
                chosen = np.full(part.num_rows, len(rules), dtype=np.int64)
                for k in reversed(ranked):
                    chosen[found[:, k]] = k
                mask = chosen == len(rules)
                rule = names.take(pa.array(chosen, mask=mask))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("host"), part.column("path"), rule, verdicts.take(pa.array(chosen))],
                    ["page_id", "host", "path", "rule", "verdict"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
