"""Embedding near-duplicates by an exact metric range join.

Unit vectors whose cosine is at least ``threshold`` are at most ``eps = sqrt(2 - 2 threshold)``
apart.  Pivots partition the vectors: each lives in the cell of its nearest pivot.  A pair in two
cells meets in the one with the smaller number, so its other vector must visit that cell.  By the
triangle inequality a vector y of cell b need not visit cell a if

    d(y, a) - d(y, b) > 2 eps            (y is farther from the border than any partner)
    d(y, a) > radius(a) + eps            (no vector of the cell is near enough)

Cells join independently.  A full cell is cut: its vectors into blocks of ``block``, what meets a
block into lots of ``lot``; each pair of block and lot is one bounded group.  Groups give the number
of links of each vector and a spanning forest of the links, never the pairs.  Equal vectors are
joined once and counted as often as they stand.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.skew import join_classes
from shelfmark.session import stored

SAMPLE, MOST_PIVOTS = 4096, 1024  # vectors that pivots are chosen from; pivots
SLACK = 1e-7  # bounds are widened by it, so that rounding loses no pair


def choose_pivots(sample: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Far apart vectors, then moved to the middle of those nearest to them: dense groups get cells of their own."""
    rng = np.random.default_rng(seed)
    pivots = [sample[int(rng.integers(len(sample)))]]
    near = np.linalg.norm(sample - pivots[0], axis=1)
    while len(pivots) < min(count, len(sample)) and near.max() > 0:
        odds = near ** 2
        pivots.append(sample[int(rng.choice(len(sample), p=odds / odds.sum()))])
        near = np.minimum(near, np.linalg.norm(sample - pivots[-1], axis=1))
    pivots = np.array(pivots)
    for _ in range(5):
        home = (sample @ pivots.T - 0.5 * (pivots ** 2).sum(axis=1)).argmax(axis=1)
        for k in range(len(pivots)):
            if (home == k).any():
                pivots[k] = sample[home == k].mean(axis=0)
    return pivots


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors ** 2).sum(axis=1)[:, None] - 2 * vectors @ pivots.T + (pivots ** 2).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _visits(distance: np.ndarray, home: np.ndarray, eps: float) -> np.ndarray:
    """Which smaller cells each vector visits, by the first bound."""
    own = distance[np.arange(len(home)), home]
    near = distance - own[:, None] <= 2 * eps + SLACK
    return near & (np.arange(distance.shape[1]) < home[:, None])


def _links(owners: pa.Table, guests: pa.Table, threshold: float, same: bool):
    """Links between two tables of vectors, as counts per vector and a spanning forest; ``same``: all pairs of one table."""
    a, b = _matrix(owners.column("unit")), _matrix(guests.column("unit"))
    ida, idb = owners.column("vec").to_numpy(), guests.column("vec").to_numpy()
    na, nb = owners.column("copies").to_numpy(), guests.column("copies").to_numpy()
    counts_a, counts_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    label = np.arange(len(a))  # components of the owners so far
    edges: list[tuple[int, int]] = []
    for k in range(0, len(b), 512):
        near = a @ b[k: k + 512].T >= threshold
        if same:
            near[np.arange(k, min(k + 512, len(b))), np.arange(min(512, len(b) - k))] = False
        counts_a += near @ nb[k: k + 512]
        counts_b[k: k + 512] += na @ near
        for j in np.flatnonzero(near.any(axis=0)):
            met = np.flatnonzero(near[:, j])
            edges.append((int(ida[met[0]]), int(idb[k + j])))
            labels = np.unique(label[met])
            if len(labels) > 1:
                edges.extend((int(ida[labels[0]]), int(ida[other])) for other in labels[1:])
                label[np.isin(label, labels)] = labels[0]
    return ida, counts_a, idb, (np.zeros_like(counts_b) if same else counts_b), edges


def range_join(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
               target: int = 8192, block: int = 4096, lot: int = 16384) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row.

    ``n_links`` counts the other rows whose cosine with it, in double precision, is at least ``threshold``;
    ``component_id`` is the least id that its links reach; ``kept`` marks it.  A vector that is null, empty,
    zero, or holds a null or non-finite component links with nothing, as do vectors of different lengths.
    Rows of equal id are rows each and share a component; a row without an id gives links but has no
    component of its own.  Other columns play no part; no rows give no rows.
    """
    spark = vectors.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    largest = F.aggregate("v", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x)))
    finite = F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = rows.withColumn("v", F.when(finite & (largest > 0), F.transform("v", lambda x: x / largest)))  # no overflow in squares
    rows = stored(rows.withColumn("unit", F.transform("v", lambda x: x / F.sqrt(square))).select("vec_id", "unit"), "vectors")
    classes = rows.where("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select("unit", "least", "copies", F.size("unit").alias("dim"), F.monotonically_increasing_id().alias("vec")), "vector-classes")
    links, forest = None, None
    for dim, n in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():  # as a rule one length
        counts, edges = _cells(spark, classes.where(F.col("dim") == dim), n, threshold, eps, target, block, lot)
        links, forest = (counts, edges) if links is None else (links.unionByName(counts), forest.unionByName(edges))
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = links.groupBy("vec").agg(F.sum("n").alias("n"))
    grouped = components(forest).withColumnRenamed("node", "vec")
    known = classes.join(linked, "vec", "left").join(grouped, "vec", "left").select("unit", "least", "copies", "n", F.coalesce("component", "vec").alias("component"))
    known = stored(known, "vector-links")
    roots = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(roots, "component").select("unit", "copies", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    joined = join_classes(rows.where("unit is not null"), stored(known, "vector-known"), "unit", "copies").unionByName(rows.where("unit is null"), allowMissingColumns=True)
    result = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull())


def _cells(spark, classes: DataFrame, n: int, threshold: float, eps: float, target: int, block: int, lot: int):
    """Counts and forest over vectors of one length."""
    sample = classes.orderBy(F.xxhash64("unit")).limit(SAMPLE).select("unit").toArrow()
    count = max(1, min(MOST_PIVOTS, -(-n // target)))
    pivots = choose_pivots(_matrix(sample.column("unit")), count)
    shared = spark.sparkContext.broadcast(pivots)

    def survey(batches):
        """How many live in each cell, how far from its pivot, and how many would visit it."""
        pivots = shared.value
        lives, visits, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
        for batch in batches:
            if batch.num_rows:
                distance = distances(_matrix(batch.column("unit")), pivots)
                home = distance.argmin(axis=1)
                lives += np.bincount(home, minlength=len(pivots))
                visits += _visits(distance, home, eps).sum(axis=0)
                np.maximum.at(radius, home, distance[np.arange(len(home)), home])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(lives), pa.array(visits), pa.array(radius)], ["cell", "lives", "visits", "radius"])

    found = classes.select("unit").mapInArrow(survey, "cell long, lives long, visits long, radius double")
    found = found.groupBy("cell").agg(F.sum("lives").alias("lives"), F.sum("visits").alias("visits"), F.max("radius").alias("radius")).orderBy("cell").collect()
    radius = np.array([row.radius for row in found])
    blocks = np.array([max(1, -(-row.lives // block)) for row in found])
    lots = np.array([max(1, -(-row.visits // lot)) for row in found])
    plan = spark.sparkContext.broadcast((radius, blocks, lots))

    def deal(batches):
        """Copies of each vector for the groups it takes part in: as owner of a block, or as a guest of one."""
        pivots, (radius, blocks, lots) = shared.value, plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            distance = distances(_matrix(batch.column("unit")), pivots)
            home = distance.argmin(axis=1)
            key = (batch.column("vec").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            mine = (key % blocks[home].astype(np.uint64)).astype(np.int64)
            out: list[tuple[np.ndarray, ...]] = []
            rows = np.arange(len(home))
            # owners: once for their own block's inner pairs (lot -1) and once for each lot of guests
            out.append((rows, home, mine, np.full(len(home), -1), np.ones(len(home), dtype=bool)))
            for k in range(int(lots[home].max())):
                some = rows[lots[home] > k]
                out.append((some, home[some], mine[some], np.full(len(some), k), np.ones(len(some), dtype=bool)))
            # guests from later blocks of the same cell: groups of their own, lot -2 - block
            for k in range(int(blocks[home].max()) - 1):
                some = rows[(mine > k)]
                out.append((some, home[some], np.full(len(some), k), -2 - mine[some], np.zeros(len(some), dtype=bool)))
                some = rows[(mine == k)]
                for later in range(k + 1, int(blocks[home[some]].max()) if len(some) else 0):
                    few = some[blocks[home[some]] > later]
                    out.append((few, home[few], mine[few], np.full(len(few), -2 - later), np.ones(len(few), dtype=bool)))
            # guests from other cells
            row, cell = np.nonzero(_visits(distance, home, eps) & (distance <= radius + eps + SLACK))
            where = ((key[row] >> np.uint64(16)) % lots[cell].astype(np.uint64)).astype(np.int64)
            for k in range(int(blocks[cell].max()) if len(cell) else 0):
                some = blocks[cell] > k
                out.append((row[some], cell[some], np.full(int(some.sum()), k), where[some], np.zeros(int(some.sum()), dtype=bool)))
            for r, c, b, g, owns in out:
                for k in range(0, len(r), 4096):
                    s = slice(k, k + 4096)
                    yield pa.RecordBatch.from_arrays([pa.array(c[s]), pa.array(b[s]), pa.array(g[s]), pa.array(owns[s]), *(batch.column(x).take(pa.array(r[s])) for x in ("vec", "copies", "unit"))],
                                                     ["cell", "block", "lot", "owns", "vec", "copies", "unit"])

    dealt = classes.select("vec", "copies", "unit").mapInArrow(deal, "cell long, block long, lot long, owns boolean, vec long, copies long, unit array<double>")

    def join(group: pa.Table) -> pa.Table:
        owners = group.filter(group.column("owns"))
        same = group.column("lot")[0].as_py() == -1
        guests = owners if same else group.filter(pa.compute.invert(group.column("owns")))
        ids, counts, edges = [], [], []
        if owners.num_rows and guests.num_rows:
            ida, ca, idb, cb, edges = _links(owners, guests, threshold, same)
            ids, counts = np.concatenate([ida[ca > 0], idb[cb > 0]]), np.concatenate([ca[ca > 0], cb[cb > 0]])
        a, b = (list(x) for x in zip(*edges, strict=True)) if edges else ([], [])
        none = len(a)
        return pa.table({"vec": pa.array([*np.asarray(ids, dtype=np.int64).tolist(), *a], pa.int64()), "n": pa.array([*np.asarray(counts, dtype=np.int64).tolist(), *[None] * none], pa.int64()),
                         "other": pa.array([*[None] * len(ids), *b], pa.int64())})

    joined = stored(dealt.groupBy("cell", "block", "lot").applyInArrow(join, "vec long, n long, other long"), "vector-joins")
    return joined.where("other is null").select("vec", "n"), joined.where("other is not null").select("vec", "other")
