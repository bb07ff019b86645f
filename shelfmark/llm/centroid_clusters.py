"""Centroid clustering of whole-number vectors by scalar lookup tables.

Vectors are written once as blocks of ``BLOCK`` rows.  A block keeps, for each dimension, the values
that occur in it and each vector's place among them.  A round tabulates, for each dimension, occurring
value and centroid, the squared difference; a vector's distances to all centroids are then gathers
from these tables and sums, with no arithmetic on components.  Tables belong to a block, so that
their size is bounded (``BLOCK`` values a dimension) whatever values the data hold.

A round shuffles one row per task, centroid and dimension; the driver sees ``k * dim`` sums.

* Vectors of another length than ``dim``, or with null or non-finite components: not clustered, no row.
* Components are held within +-2**26 after scaling; sums of distances stop at the greatest long.
* Rows repeating an id are vectors of their own; equal hashes of ids go in order of their vectors.  A null id is hashed as empty text.
* Fewer vectors than ``k``: as many centroids.  No vectors: no rows.  Equal distances: the smaller number.
* Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.integer_vectors import scaled, usable
from shelfmark.session import stored

BLOCK = 4096
_MOST = (1 << 63) - 1
_BLOCKS = "ids array<long>, sizes array<int>, occurring array<int>, places binary"
_PARTIAL = "cluster int, n long, sums array<long>"
_FOUND = "vec_id long, cluster int, distance long"


def _block(ids: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    occurring, places = [], np.empty(values.shape[::-1], dtype="<u2")
    for d in range(values.shape[1]):
        found, places[d] = np.unique(values[:, d], return_inverse=True)
        occurring.append(found)
    sizes = pa.array([[len(found) for found in occurring]], pa.list_(pa.int32()))
    listed = pa.array([np.concatenate(occurring)], pa.list_(pa.int32()))
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.record_batch([ids, sizes, listed, pa.array([places.tobytes()])], ["ids", "sizes", "occurring", "places"])


def blocks(vectors: DataFrame, factor: int, dim: int) -> DataFrame:
    """The kept vectors as blocks, each task's rows in its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            while sum(b.num_rows for b in kept) >= BLOCK:
                whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                yield _block(whole["vec_id"].slice(0, BLOCK), scaled(whole["embedding"].slice(0, BLOCK), factor))
                kept = [whole.slice(BLOCK)] if whole.num_rows > BLOCK else []
        if sum(b.num_rows for b in kept):
            whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            yield _block(whole["vec_id"], scaled(whole["embedding"], factor))

    rows = vectors.where(usable("embedding", dim)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(cut, _BLOCKS)


class Tables:
    """A block against a set of centroids."""

    def __init__(self, row: dict, centroids: np.ndarray):
        self.ids = row["ids"]
        sizes = np.asarray(row["sizes"], dtype=np.int64)
        self.occurring = np.asarray(row["occurring"], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        self.places = np.frombuffer(row["places"], dtype="<u2").reshape(len(sizes), -1) + starts[:, None]
        axis = np.repeat(np.arange(len(sizes)), sizes)
        self.squares = (self.occurring[:, None] - centroids.T[axis]) ** 2  # value x centroid

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector and its distance."""
        distances = np.zeros((self.places.shape[1], self.squares.shape[1]), dtype=np.int64)
        for place in self.places:
            distances += self.squares[place]
        best = distances.argmin(axis=1)
        return best, distances[np.arange(len(best)), best]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """The sum of the vectors of each cluster, by bucket counts that stay exact below 2**53."""
        values = self.occurring[self.places]
        return np.stack([np.bincount(cluster, weights=v, minlength=k) for v in values], axis=1).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {
                "ids": batch["ids"][k].values, "sizes": batch["sizes"][k].values.to_numpy(),
                "occurring": batch["occurring"][k].values.to_numpy(), "places": batch["places"][k].as_py(),
            }


def _moved(cells: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays."""
    k, dim = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for row in _rows(batches):
            tables = Tables(row, centroids)
            cluster, _ = tables.nearest()
            count += np.bincount(cluster, minlength=k)
            total += tables.sums(cluster, k)
        some = np.flatnonzero(count)
        columns = [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))]
        yield pa.record_batch(columns, ["cluster", "n", "sums"])

    parts = cells.mapInArrow(partial, _PARTIAL).select("cluster", "n", F.posexplode("sums").alias("axis", "x"))
    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)"))
    moved = [[int(x) for x in c] for c in centroids]
    for row in parts.groupBy("cluster", "axis").agg(exact("n").alias("n"), exact("x").alias("x")).collect():  # k * dim rows
        moved[row["cluster"]][row["axis"]] = int(row["x"]) // int(row["n"])
    return np.array(moved, dtype=np.int64)


def first_centroids(vectors: DataFrame, k: int, dim: int, factor: int, salt: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in the order of these hashes."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("long").cast("string"), F.lit("")))
    chosen = vectors.where(usable("embedding", dim)).select(F.sha2(name, 256).alias("h"), "embedding").orderBy("h", "embedding").limit(k)
    lists = [row["embedding"] for row in chosen.collect()]  # k rows
    return scaled(pa.array(lists, pa.list_(pa.float64())), factor).astype(np.int64) if lists else np.zeros((0, dim), dtype=np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, factor: int = 256, salt: str = "2") -> DataFrame:
    """One row per clustered vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, dim, factor, salt)
    if not len(centroids):
        return spark.createDataFrame([], f"{_FOUND}, cluster_inertia long, inertia long, centroid_sha256 string")
    cells = stored(blocks(vectors, factor, dim), "blocks")
    for _ in range(rounds):
        centroids = _moved(cells, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            best, distance = Tables(row, centroids).nearest()
            yield pa.record_batch([row["ids"], pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = stored(cells.mapInArrow(assign, _FOUND), "clusters")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    whole = sum(int(row["s"]) for row in per)
    texts = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame(
        [(row["cluster"], min(int(row["s"]), _MOST), min(whole, _MOST), texts[row["cluster"]]) for row in per],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
