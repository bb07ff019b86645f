"""SRC-1: JSON arrays of objects, cut into tasks by byte ranges, with the order of the source.

The text source cuts files of any size at closing braces, so a task's block begins and ends in the middle of the
array, of an object or of a string.  Where objects begin and end follows from sums over what comes before: the number of
quotes tells whether a byte stands in a string, the braces and brackets outside strings its depth.  One
scan takes both sums of each block (the depth under either assumption about its first byte), a running sum over a
file's blocks gives each its beginning, and a second scan cuts out the objects.  An object over several blocks is put
together from its fragments; all others never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.session import stored

_QUOTE, _SLASH, _OPEN, _CLOSE = (ord(c) for c in '"\\{}')
_STEP = np.zeros(256, dtype=np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_BETWEEN = np.zeros(256, dtype=bool)  # what may stand between the objects of an array
_BETWEEN[[*b" \t\r\n,"]] = True
FILE_BYTES = 1 << 40  # the order of a row is that of its file, then its place
MOST_BLOCKS = 500_000  # whose beginnings are broadcast


class NotAnArray(ValueError):
    """A file holds something else than an array of objects."""


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray, pa.RecordBatch]]:
    """Runs of rows of one block as bytes, with the braces that the source took away."""
    for batch in batches:
        paths, starts = batch["path"].dictionary_encode(), batch["block"].to_numpy()
        codes = paths.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = batch.slice(a, b - a)
            if part.num_rows:
                text = "}".join(part["value"].to_pylist()) + "}"
                yield (paths[a].as_py(), int(starts[a])), np.frombuffer(text.encode(), dtype=np.uint8), part


def _quotes(data: np.ndarray) -> np.ndarray:
    """Quotes that begin or end a string: those after an even number of backslashes."""
    quote = data == _QUOTE
    if (data == _SLASH).any():
        at = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(data != _SLASH, at, -1))
        run = np.zeros(len(data), dtype=np.int64)
        run[1:] = at[:-1] - plain[:-1]
        quote &= run % 2 == 0
    return quote


def _inside(quote: np.ndarray, first: int) -> np.ndarray:
    """Whether each byte stands in a string or is a quote, if the first stands in one (``first`` 1) or not."""
    after = np.cumsum(quote) + first
    return (after % 2 == 1) | quote


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: the parity of its quotes, and its change of depth from either beginning."""
    now, parity, change = None, 0, [0, 0]

    def row() -> pa.RecordBatch:
        columns = [pa.array([now[0]]), pa.array([now[1]]), pa.array([parity], pa.int32()), *[pa.array([x], pa.int64()) for x in change]]
        return pa.record_batch(columns, ["path", "block", "parity", "outer", "inner"])

    for block, data, _ in _blocks(batches):
        if block != now:
            if now is not None:
                yield row()
            now, parity, change = block, 0, [0, 0]
        quote, step = _quotes(data), _STEP[data]
        for first in (0, 1):
            change[first] += int(step[~_inside(quote, (parity + first) % 2)].sum())
        parity = (parity + int(quote.sum())) % 2
    if now is not None:
        yield row()


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of each block (``kind`` whole), and fragments of those that begin (tail), end (head) or go on (middle) in it."""
    now, inside, depth, offset = None, 0, 0, 0
    open_text, open_at, begun = None, 0, True  # the object that is not ended yet, its place, and if it began in this block

    def rows(found: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([now[0]] * len(found)), pa.array([now[1]] * len(found)), pa.array([f[0] for f in found], pa.int64()),
                   pa.array([f[1] for f in found]), pa.array([f[2].decode() for f in found], pa.string())]
        return pa.record_batch(columns, ["path", "block", "place", "kind", "text"])

    for block, data, part in _blocks(batches):
        if block != now:
            if open_text is not None:
                yield rows([(open_at, "tail" if begun else "middle", open_text)])
            now, offset = block, block[1]
            inside, depth = part["inside"][0].as_py(), part["depth"][0].as_py()
            open_text, open_at, begun = (b"", block[1], False) if depth >= 2 else (None, 0, True)
        quote = _quotes(data)
        quoted = _inside(quote, inside)
        level = np.cumsum(np.where(quoted, 0, _STEP[data])) + depth
        ending = (data == _CLOSE) & (level == 1) & ~quoted
        member = (level >= 2) | ending
        before = np.concatenate([[open_text is not None], member[:-1] & ~ending[:-1]])
        starting = member & ~before
        between = ~quoted & np.where(level == 1, _BETWEEN[data] | (data == ord("[")), (level == 0) & (_BETWEEN[data] | (data == ord("]"))))
        if not (member | between | ((level == -1) & (data == _CLOSE))).all() or (data[starting] != _OPEN).any():
            raise NotAnArray(f"not a list of posts: {now[0]}")
        raw, found = data.tobytes(), []
        starts, ends = np.flatnonzero(starting).tolist(), (np.flatnonzero(ending) + 1).tolist()
        if open_text is not None:
            if ends:
                found.append((open_at, "whole" if begun else "head", open_text + raw[: ends[0]]))
                open_text, ends = None, ends[1:]
            else:
                open_text += raw
        found += [(offset + a, "whole", raw[a:b]) for a, b in zip(starts, ends)]
        if len(starts) > len(ends):
            open_text, open_at, begun = raw[starts[-1]:], offset + starts[-1], True
        if found:
            yield rows(found)
        inside = (inside + int(quote.sum())) % 2
        depth, offset = int(level[-1]), offset + len(data)
    if open_text is not None:
        yield rows([(open_at, "tail" if begun else "middle", open_text)])


_SUMS = "path string, block long, parity int, outer long, inner long"
_FOUND = "path string, block long, place long, kind string, text string"


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``seq, text``: every object of the arrays under ``path``, ``seq`` ascending in the order of the source.

    Files come by length of their path, then by path (page-2 before page-10).  A file that holds something else, or ends
    early, raises when the rows are read.
    """
    c = F.col
    pieces = spark.read.option("lineSep", "}").text(path).select(
        c("_metadata.file_path").alias("path"), c("_metadata.file_block_start").alias("block"), "value")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(pieces.mapInArrow(_sums, _SUMS), "sums")  # one row a block
    if begins.count() > MOST_BLOCKS:
        raise ValueError("too many blocks: raise spark.sql.files.maxPartitionBytes")
    begins = begins.withColumn("inside", (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).cast("int"))
    begins = begins.withColumn("change", F.when(c("inside") == 1, c("inner")).otherwise(c("outer")))
    begins = begins.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    last = F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull()
    whole = (c("depth") + c("change") == -1) & ((c("inside") + c("parity")) % 2 == 0)  # the brace after the end takes it below 0
    fail = F.raise_error(F.concat(F.lit("not a list of posts: "), "path")).cast("long")
    begins = begins.withColumn("depth", F.when(last & ~whole, fail).otherwise(c("depth"))).select("path", "block", "inside", "depth")
    found = stored(pieces.join(F.broadcast(begins), ["path", "block"]).mapInArrow(_objects, _FOUND), "objects")
    numbers = begins.select("path").distinct().withColumn(
        "file", F.row_number().over(Window.orderBy(F.length("path"), "path")))  # one row a file

    # at most two fragments a block; an object's first is its tail of the block where it begins
    pieces_of = found.where("kind <> 'whole'").withColumn(
        "object", F.sum((c("kind") == "tail").cast("int")).over(Window.partitionBy("path").orderBy("block", "place")))
    joined = pieces_of.groupBy("path", "object").agg(
        F.min("place").alias("place"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "text"))), lambda p: p["text"]), "").alias("text"))
    objects = found.where("kind = 'whole'").select("path", "place", "text").unionByName(joined.select("path", "place", "text"))
    return objects.join(F.broadcast(numbers), "path").select((c("file") * FILE_BYTES + c("place")).alias("seq"), "text")
