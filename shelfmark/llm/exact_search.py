"""Exact top-k search by inner product of whole-number vectors: tiled matrix products.

Rows are written once as tiles of ``TILE`` vectors of one length.  Queries go round by round: a round's
queries are broadcast after their bytes were counted (``round_bytes``), every task multiplies its tiles
with blocks of ``QUERIES`` of them, selects per tile what can enter a query's list, and keeps one list of
``k`` per query.  The lists of all tasks are merged in a tree, ``FAN`` at a time.  Each round is
written on its own, so a lost executor repeats its tasks only.

Products run in double precision where every partial sum stays below 2**53, else in 64-bit integers: scores are exact.

* Null vectors, and vectors with null or non-finite components: neither queries nor candidates.
* A query meets vectors of its own length, but for its own row; rows repeating its id are candidates.
* Equal scores: the smaller id, null ids last.  Repeated queries have a list each.  A query without candidates has no row.
* Components are held within +-2**26 after scaling, so scores of up to 2**11 components fit a long.
* Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.integer_vectors import scaled, usable
from shelfmark.session import stored, work_dir

TILE, QUERIES, FAN = 8192, 256, 16
TILE_BYTES, ROUND_BYTES = 2 << 20, 32 << 20  # of components, in a tile and in a round's queries
_EXACT = 1 << 53
_TILES = "tile long, dim int, ids array<long>, asking array<int>, data binary"
_ASKED = "tile long, dim int, ids array<long>, at array<int>, data binary, bytes long"
_LISTS = "tile long, at int, query_id long, part int, vec_id long, score long"


def _list(values) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def tiles(vectors: DataFrame, asks: Column, factor: int, most: int) -> DataFrame:
    """The usable vectors as tiles of one length; no shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count = TaskContext.get().partitionId() << 32, 0
        kept: dict[int, list[pa.RecordBatch]] = {}
        waiting = 0

        def emit(dim: int) -> pa.RecordBatch:
            nonlocal count, waiting
            whole = pa.Table.from_batches(kept.pop(dim)).combine_chunks().to_batches()[0]
            waiting -= whole.num_rows
            count += 1
            asking = np.flatnonzero(whole["asks"].to_numpy(zero_copy_only=False)).astype(np.int32)
            data = scaled(whole["embedding"], factor).tobytes()
            columns = [pa.array([first + count - 1]), pa.array([dim], pa.int32()), _list(whole["vec_id"]), _list(asking), pa.array([data])]
            return pa.record_batch(columns, ["tile", "dim", "ids", "asking", "data"])

        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                size = max(1, min(most, TILE_BYTES // (4 * dim)))
                while rows.num_rows:
                    room = size - sum(b.num_rows for b in kept.get(dim, ()))
                    kept.setdefault(dim, []).append(rows.slice(0, room))
                    waiting += min(room, rows.num_rows)
                    if rows.num_rows >= room:
                        yield emit(dim)
                    rows = rows.slice(room)
            while waiting > 2 * most:  # many lengths: the fullest goes
                yield emit(max(kept, key=lambda d: sum(b.num_rows for b in kept[d])))
        for dim in sorted(kept):
            yield emit(dim)

    rows = vectors.where(usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"), F.coalesce(asks, F.lit(False)).alias("asks"))
    return rows.mapInArrow(cut, _TILES)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of each tile."""
    for batch in batches:
        for k in range(batch.num_rows):
            at = batch["asking"][k].values
            dim = batch["dim"][k].as_py()
            data = np.frombuffer(batch["data"][k].as_py(), dtype=np.int32).reshape(-1, dim)[at.to_numpy()].tobytes()
            columns = [batch["tile"].slice(k, 1), batch["dim"].slice(k, 1), _list(batch["ids"][k].values.take(at)), _list(at), pa.array([data]), pa.array([len(data)])]
            yield pa.record_batch(columns, ["tile", "dim", "ids", "at", "data", "bytes"])


class Lists:
    """The queries of one length and the best ``k`` candidates seen for each."""

    def __init__(self, rows: list[dict], dim: int, k: int):
        self.k = k
        self.tile = np.concatenate([np.full(len(r["at"]), r["tile"], dtype=np.int64) for r in rows])
        self.at = np.concatenate([np.asarray(r["at"], dtype=np.int32) for r in rows])
        self.ids = [i for r in rows for i in r["ids"]]
        self.vectors = np.concatenate([np.frombuffer(r["data"], dtype=np.int32).reshape(-1, dim) for r in rows])
        self.greatest = int(np.abs(self.vectors).max(initial=0))
        n = len(self.at)
        self.filled = np.zeros(n, dtype=np.int64)
        self.score = np.zeros((n, k), dtype=np.int64)
        self.vec_id = np.zeros((n, k), dtype=np.int64)
        self.unnamed = np.zeros((n, k), dtype=bool)

    def add(self, tile: int, ids: np.ndarray, unnamed: np.ndarray, data: np.ndarray) -> None:
        exact = self.greatest * int(np.abs(data).max(initial=0)) * data.shape[1] < _EXACT
        kind = np.float64 if exact else np.int64
        right = data.T.astype(kind)
        for start in range(0, len(self.at), QUERIES):
            chunk = slice(start, start + QUERIES)
            self._merge(start, self.vectors[chunk].astype(kind) @ right, tile, ids, unnamed)

    def _merge(self, start: int, scores: np.ndarray, tile: int, ids: np.ndarray, unnamed: np.ndarray) -> None:
        chunk = slice(start, start + len(scores))
        lowest = -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min
        own = np.where(self.tile[chunk] == tile, self.at[chunk], -1)
        itself = np.flatnonzero(own >= 0)
        scores[itself, own[itself]] = lowest
        k, n = self.k, scores.shape[1]
        floor = np.where(self.filled[chunk] == k, self.score[chunk, -1], lowest)
        if n > k:  # the k-th best of the tile
            floor = np.maximum(floor, np.partition(scores, n - k, axis=1)[:, n - k])
        query, column = np.nonzero(scores >= floor[:, None])
        other = column != own[query]
        query, column = query[other], column[other]
        if not len(query):
            return
        old_query, old_place = np.nonzero(np.arange(k) < self.filled[chunk, None])
        changed = np.zeros(len(scores), dtype=bool)
        changed[query] = True
        old = changed[old_query]
        old_query, old_place = old_query[old], old_place[old]
        rows = np.concatenate([old_query, query])
        value = np.concatenate([self.score[start + old_query, old_place], scores[query, column].astype(np.int64)])
        name = np.concatenate([self.vec_id[start + old_query, old_place], ids[column]])
        none = np.concatenate([self.unnamed[start + old_query, old_place], unnamed[column]])
        order = np.lexsort((name, none, -value, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order, rows, place = order[place < k], rows[place < k], place[place < k]
        self.score[start + rows, place] = value[order]
        self.vec_id[start + rows, place] = name[order]
        self.unnamed[start + rows, place] = none[order]
        self.filled[chunk] = np.maximum(self.filled[chunk], np.bincount(rows, minlength=len(scores)))

    def result(self, part: int) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.at), 4096):
            chunk = slice(start, start + 4096)
            query, place = np.nonzero(np.arange(self.k) < self.filled[chunk, None])
            query += start
            columns = [
                pa.array(self.tile[query]), pa.array(self.at[query]), pa.array(self.ids, pa.int64()).take(pa.array(query)),
                pa.array(np.full(len(query), part, dtype=np.int32)),
                pa.array(self.vec_id[query, place], mask=self.unnamed[query, place]), pa.array(self.score[query, place])]
            yield pa.record_batch(columns, ["tile", "at", "query_id", "part", "vec_id", "score"])


def _scorer(shared: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list[dict]] = {}
        for row in shared.value:
            by_dim.setdefault(row["dim"], []).append(row)
        lists = {dim: Lists(rows, dim, k) for dim, rows in by_dim.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch["dim"][i].as_py()
                if dim in lists:
                    ids = batch["ids"][i].values
                    data = np.frombuffer(batch["data"][i].as_py(), dtype=np.int32).reshape(-1, dim)
                    unnamed = ids.is_null().to_numpy(zero_copy_only=False)
                    lists[dim].add(batch["tile"][i].as_py(), ids.fill_null(0).to_numpy(), unnamed, data)
        part = TaskContext.get().partitionId()
        for found in lists.values():
            yield from found.result(part)

    return run


def _best(lists: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """One list per query: lists of ``FAN`` neighbouring parts become one until one part is left."""
    while parts > FAN:
        parts = math.ceil(parts / FAN)
        lists = _best(lists.withColumn("part", F.floor(F.col("part") / FAN).cast("int")), ["tile", "at", "part"], k).drop("rank")
    return _best(lists, ["tile", "at"], k)


def top_k(
    vectors: DataFrame, asks: Column, k: int = 10, factor: int = 1024, round_bytes: int = ROUND_BYTES, tile: int = TILE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` rows for each row of ``vec_id, embedding`` where ``asks`` holds."""
    spark = vectors.sparkSession
    cells = stored(tiles(vectors, asks, factor, tile), "tiles")
    asked = stored(cells.where(F.size("asking") > 0).mapInArrow(_asked, _ASKED), "asked")
    total, widest = asked.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.max("bytes")).first()
    rounds = math.ceil(total / round_bytes)
    if not rounds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    while True:  # until no round is much larger than asked for
        dealt = asked.withColumn("round", F.pmod(F.xxhash64("tile"), F.lit(rounds)).cast("int"))
        if dealt.groupBy("round").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] <= 2 * max(round_bytes, widest):
            break
        rounds *= 2
    folder = work_dir(spark, "lists")
    for number in range(rounds):
        block = [row.asDict() for row in dealt.where(F.col("round") == number).collect()]  # bytes counted above
        shared = spark.sparkContext.broadcast(block)
        cells.select("tile", "dim", "ids", "data").mapInArrow(_scorer(shared, k), _LISTS).write.parquet(f"{folder}/round={number}")
        shared.destroy()
    lists = spark.read.schema(_LISTS).parquet(*[f"{folder}/round={number}" for number in range(rounds)])
    parts = lists.agg(F.max("part")).first()[0]
    return merged(lists, (parts or 0) + 1, k).select("query_id", "rank", "vec_id", "score")
