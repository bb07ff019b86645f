"""Bounded-space online packing of token ids into sequences of a fixed length.

Each task keeps at most ``windows`` open sequences.  A document's last piece goes into the open
window that it fills best; when none has room, the fullest window is emitted and a new one is
opened.  Documents longer than a sequence give full sequences first.  What is still open when a
partition ends is leftover: leftovers of many partitions meet in one task, which fills
sequences to the brim, cutting pieces where they end, so that at most one is not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrays import claim, slices
from shelfmark.llm.encoding import encoder
from shelfmark.session import stored

_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"

SLICE = 1 << 20  # bytes of text that are encoded at once

Piece = tuple[int | None, int, int, np.ndarray]  # document, start, tokens of the document, ids


class OpenWindows:
    """At most ``most`` open sequences of ``length`` ids; closed ones are handed out."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.pieces: list[list[Piece]] = []
        self.free: list[int] = []

    def add(self, piece: Piece) -> list[Piece] | None:
        """Place a piece shorter than a sequence; the closed sequence, if one had to go."""
        need, closed = len(piece[3]), None
        fits = [(room, k) for k, room in enumerate(self.free) if room >= need]
        if fits:
            _, k = min(fits)
        else:
            if len(self.free) == self.most:
                closed = self._close(min(range(self.most), key=self.free.__getitem__))
            self.pieces.append([])
            self.free.append(self.length)
            k = len(self.free) - 1
        self.pieces[k].append(piece)
        self.free[k] -= need
        return closed if self.free[k] else self._close(k)  # a new window is never full: the piece is shorter

    def _close(self, k: int) -> list[Piece]:
        self.free.pop(k)
        return self.pieces.pop(k)


def _table(sequences: list[list[Piece]], numbers: list[int], left: bool) -> Iterator[pa.RecordBatch]:
    import zlib

    if not sequences:
        return
    pieces = [piece for sequence in sequences for piece in sequence]
    lengths = np.array([len(piece[3]) for piece in pieces], dtype=np.int64)
    offsets = np.concatenate([np.cumsum([0, *(len(piece[3]) for piece in sequence)])[:-1] for sequence in sequences])
    ids = np.concatenate([piece[3] for piece in pieces])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    raw = memoryview(ids.astype("<u4").tobytes())
    yield pa.RecordBatch.from_arrays([
        pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()), pa.array(lengths),
        pa.array([zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64()),
        pa.array([p[2] for p in pieces], pa.int64()),
        pa.array([None if left else n for n, sequence in zip(numbers, sequences, strict=True) for _ in sequence], pa.int64()),
        pa.array(offsets.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))],
        schema=pa.schema(_FIELDS))


def _packer(path: str, end_id: int, length: int, windows: int):
    """One pass over a partition: closed sequences as they come, then what stays open (``sequence_id`` null)."""

    def run(batches):
        open_windows, number = OpenWindows(length, windows), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                base = part.column("part")[0].as_py() << 32
                ids, offsets = encoder(path).encode(part.column("text"))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(part.num_rows + 1)
                closed: list[list[Piece]] = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    total, at = b - a, a
                    while b - at >= length:
                        closed.append([(doc, at - a, total, ids[at: at + length])])
                        at += length
                    if at < b and (done := open_windows.add((doc, at - a, total, ids[at:b].copy()))):
                        closed.append(done)
                yield from _table(closed, [base + number + k for k in range(len(closed))], left=False)
                number += len(closed)
        yield from _table(open_windows.pieces, [0] * len(open_windows.pieces), left=True)

    return run


FILL = 512  # sequences that a merging task fills, on average
HELD = 256  # and so many are filled at once


def _merger(length: int):
    """Fill sequences to the brim with leftover pieces, longest first; pieces are cut at the brim."""

    def run(batches):
        claim("packing")  # the encoder's memory goes
        pieces: list[Piece] = []
        held, number, base = 0, 0, 0

        def fill(last: bool):
            nonlocal pieces, held, number
            sequences, current, room = [], [], length
            pieces.sort(key=lambda p: (-len(p[3]), p[0] is None, p[0] or 0, p[1]))
            for doc, start, total, ids in pieces:
                while len(ids):
                    take = min(room, len(ids))
                    current.append((doc, start, total, ids[:take]))
                    start, ids, room = start + take, ids[take:], room - take
                    if not room:
                        sequences.append(current)
                        current, room = [], length
            if current and last:
                sequences.append(current)
                current = []
            pieces, held = current, sum(len(p[3]) for p in current)
            out = list(_table(sequences, [base + number + k for k in range(len(sequences))], left=False))
            number += len(sequences)
            return out

        for batch in batches:
            for part in _bounded(batch, HELD):
                base = (1 << 62) + (part.column("part")[0].as_py() << 32)
                flat = part.column("ids").flatten().to_numpy().astype(np.uint32)
                ends = np.cumsum(part.column("length").to_numpy())
                for doc, start, total, end, n in zip(*(part.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")), ends.tolist(), part.column("length").to_pylist(), strict=True):
                    pieces.append((doc, start, total, flat[end - n: end]))
                    held += n
                if held >= HELD * length:
                    yield from fill(False)
        if pieces:
            yield from fill(True)

    return run


def _bounded(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def pack(docs: DataFrame, path: str, end_id: int, length: int = 4096, windows: int = 64,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    A document's ids are those of its whole text and ``end_id``; every id is in exactly one piece.
    ``start`` counts the document's ids before the piece, ``offset`` the sequence's.  Sequences
    shorter than ``length`` are to be padded: one for each merging task at most.  A null or
    empty text is the end id alone; rows of equal or null id are packed each; other columns play no
    part; no rows give no rows.
    """
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = stored(rows.mapInArrow(_packer(path, end_id, length, windows), _SCHEMA), "packed")
    left = packed.where("sequence_id is null")
    held = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    left = left.repartition(max(1, held // (FILL * length)), "doc_id", "start").sortWithinPartitions("doc_id", "start")
    merged = left.withColumn("part", F.spark_partition_id()).mapInArrow(_merger(length), _SCHEMA)
    return packed.where("sequence_id is not null").unionByName(merged)
