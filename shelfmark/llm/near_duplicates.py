"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. A document's set is its distinct shingles of five words.  Documents of equal sets form a class,
   stood for by one node; everything below is about nodes.
2. ``BANDS`` bands of ``ROWS`` MinHash values each propose candidates.  At similarity 0.75 two
   documents share no band with probability (1 - 0.75^4)^32 < 1e-5.
3. Candidates are compared on ``SKETCH`` bytes of their signatures in batches of ``BATCH``.  After
   each batch the posterior of the similarity (uniform prior) is bounded: a pair is dropped once the
   probability that it reaches the threshold is below ``miss``.  That is a table of least matches.
4. Survivors are compared on their full sets; only those links count.

First every member of a bucket is compared with the bucket's least member, so a large group takes as
many comparisons as it has members.  Then buckets that still hold several components are searched
for links between different components: their members are dealt into cells of bounded size, the
members of the largest component of a bucket meet the others only, each pair in the first band that it
shares, and full sets join the cells of their survivors, so pairs never leave a cell and links only as
a forest.  Copies are never expanded into pairs, and no link between different components is left
untried.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrays import _BASE, claim, mix, slices, text_bytes, windows_hash, words
from shelfmark.llm.components import components
from shelfmark.llm.skew import join_classes
from shelfmark.session import stored

SHINGLE, BANDS, ROWS = 5, 32, 4
SKETCH, BATCH = 128, 16
CELL = 256  # members of a bucket in one cell, of each side


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(shingles, offsets)``: the sorted distinct shingles of each text; a shorter text is one shingle."""
    lengths = np.diff(offsets)
    every = windows_hash(hashes, SHINGLE)
    counts = np.maximum(lengths - SHINGLE + 1, 0)
    at = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    text = np.repeat(np.arange(len(lengths)), counts)
    values = every[at]
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        whole = [windows_hash(hashes[offsets[k]: offsets[k + 1]], int(lengths[k]))[0] ^ np.uint64(lengths[k]) for k in short]
        text, values = np.concatenate([text, short]), np.concatenate([values, np.array(whole, dtype=np.uint64)])
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[fresh], np.concatenate([[0], np.cumsum(np.bincount(text[fresh], minlength=len(lengths)))])


_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * _BASE).reshape(2, -1)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets, one row per set."""
    starts = offsets[:-1]
    out = np.empty((len(starts), BANDS * ROWS), dtype=np.uint32)
    low = values.astype(np.uint32)
    high = (values >> np.uint64(32)).astype(np.uint32)
    for k in range(BANDS * ROWS):
        hashed = (low ^ np.uint32(_SEEDS[0, k] & np.uint64(0xFFFFFFFF))) * np.uint32(_SEEDS[1, k] & np.uint64(0xFFFFFFFF) | np.uint64(1))
        hashed ^= high
        hashed *= np.uint32(_SEEDS[1, k] >> np.uint64(32) | np.uint64(1))
        out[:, k] = np.minimum.reduceat(hashed, starts)
    return out


@cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch, the least number of equal bytes with which a pair goes on.

    With ``m`` of ``n`` values equal, the similarity's posterior is Beta(m + 1, n - m + 1); its tail
    above the threshold is that of a binomial.  Unrelated bytes are equal once in 256 times,
    which only keeps more pairs.
    """
    def tail(m: int, n: int) -> float:  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        return sum(math.comb(n + 1, k) * threshold ** k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return tuple(next(m for m in range(n + 1) if tail(m, n) >= miss) for n in range(BATCH, SKETCH + 1, BATCH))


def likely(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """``(pairs that survive, their equal bytes)`` for row-wise pairs of sketches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for step, least in enumerate(least_matches(threshold, miss)):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive, matches


def _set_key(values: np.ndarray) -> bytes | None:
    """A 192-bit key of a set: two sums of mixed shingles, and the size."""
    if not len(values):
        return None
    return mix(values).sum().tobytes() + mix(values ^ _BASE).sum().tobytes() + len(values).to_bytes(8, "little")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), SKETCH)


def _sign(batches):
    """Of each document: set size, a key of the set, the band keys, and the sketch."""
    claim("near duplicates")
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            values, offsets = shingle_sets(*words(*text_bytes(part.column("text"))))
            counts = np.diff(offsets)
            full = np.flatnonzero(counts)
            keys, bands, sketches = [None] * len(counts), [None] * len(counts), [None] * len(counts)
            if len(full):
                compact = np.concatenate([[0], np.cumsum(counts[full])])
                signature = signatures(values, compact)
                band = np.zeros((len(full), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    band = mix(band * _BASE + signature[:, r::ROWS])
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * _BASE).view(np.int64)
                sketch = (mix(signature) & np.uint64(255)).astype(np.uint8)
                for i, k in enumerate(full):
                    keys[k], bands[k], sketches[k] = _set_key(values[offsets[k]: offsets[k + 1]]), band[i], sketch[i].tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                                             ["doc_id", "n_shingles", "set_key", "bands", "sketch"])


def _survivors(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs ``a, sketch_a, b, sketch_b`` that the sketches do not rule out."""

    def prune(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                part = batch.slice(k, 8192)
                alive, _ = likely(_sketches(part.column("sketch_a")), _sketches(part.column("sketch_b")), threshold, miss)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(alive)) for c in ("a", "b")], ["a", "b"])

    return pairs.mapInArrow(prune, "a long, b long")


def _sets(nodes: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, shingles`` of the named nodes; only their texts are made into sets again."""
    named = stored(heads.select("node", "doc_id", "set_key").join(nodes.distinct(), "node", "left_semi"), "named")

    def sets(batches):
        claim("near duplicates")
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                values, offsets = shingle_sets(*words(*text_bytes(part.column("text"))))
                every = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_set_key(v) for v in every], pa.binary()), pa.array([v.tobytes() for v in every], pa.binary())], ["doc_id", "set_key", "shingles"])

    found = texts.join(named.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, set_key binary, shingles binary")
    return stored(found.join(named, ["doc_id", "set_key"]).select("node", "shingles").dropDuplicates(["node"]), "shingle-sets")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    merged = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (both - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""

    def confirm(batches):
        for batch in batches:
            good = [_alike(*(np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in both), percent) for both in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    both = pairs.join(sets.toDF("a", "shingles_a"), "a").join(sets.toDF("b", "shingles_b"), "b")
    return stored(both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(confirm, "a long, b long"), "links")


def _across(members: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Likely pairs of different components that share a bucket: ``cell, a, b``, one row of arrays for each cell.

    ``members`` has ``bucket, band, least, node, component, sketch, marks``.  A bucket's largest component is
    its bulk: bulk members need not meet each other.  Others and bulk are dealt into lots of CELL by hash; each
    lot of others meets each lot of bulk and each lot of others in a cell.  A pair counts in the first band that
    it shares, and not if the bucket's least member, to which all were compared, is in it.
    """
    parts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    shapes = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("bulk"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    lots = lambda n: F.greatest(F.lit(1), F.ceil(n / CELL)).cast("int")
    shapes = shapes.select("bucket", F.col("bulk.component").alias("bulk"), lots(F.col("bulk.n")).alias("bulk_lots"), lots(F.col("n") - F.col("bulk.n")).alias("other_lots"))
    rows = members.join(shapes, "bucket").withColumn("is_bulk", F.col("component") == F.col("bulk"))
    lot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    mine = F.when(F.col("is_bulk"), lot(F.col("bulk_lots"))).otherwise(lot(F.col("other_lots")))
    others = F.sequence(F.lit(0), F.col("other_lots") - 1)
    # cells: (i, -1 - k): others lot i with bulk lot k;  (i, j), i <= j: others lots i and j
    cells = F.when(F.col("is_bulk"), F.transform(others, lambda i: F.struct(i.alias("i"), (-1 - F.col("lot")).alias("j")))).otherwise(F.concat(
        F.transform(F.sequence(F.lit(0), F.col("bulk_lots") - 1), lambda k: F.struct(F.col("lot").alias("i"), (-1 - k).alias("j"))),
        F.transform(others, lambda j: F.struct(F.least("lot", j).alias("i"), F.greatest("lot", j).alias("j")))))
    dealt = rows.withColumn("lot", mine).withColumn("cell", F.explode(cells)).select(F.xxhash64("bucket", "cell.i", "cell.j").alias("cell"), "is_bulk", "band", "least", "node", "component", "sketch", "marks")

    def search(batches):
        def group(table: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
            ids, component = table.column("node").to_numpy(), table.column("component").to_numpy()
            if (component == component[0]).all():
                return None
            bulk = np.asarray(table.column("is_bulk").to_pylist(), dtype=bool)
            sketch, band = _sketches(table.column("sketch")), table.column("band")[0].as_py()
            marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), dtype="<u4").reshape(len(ids), BANDS)
            i, j = np.triu_indices(len(ids), 1) if not bulk.any() else (x.reshape(-1) for x in np.meshgrid(np.flatnonzero(~bulk), np.flatnonzero(bulk), indexing="ij"))
            tried = ids == table.column("least").to_numpy()
            new = (component[i] != component[j]) & ~tried[i] & ~tried[j]
            i, j = i[new], j[new]
            alive, _ = likely_pairs(sketch, i, j, threshold, miss)
            i, j = i[alive], j[alive]
            first = ~(marks[i, :band] == marks[j, :band]).any(axis=1)
            return (ids[i[first]], ids[j[first]]) if first.any() else None

        held: list[pa.RecordBatch] = []
        current = None

        def flush():
            found = group(pa.Table.from_batches(held)) if sum(b.num_rows for b in held) > 1 else None
            held.clear()
            if found is not None:
                yield pa.RecordBatch.from_pydict({"cell": pa.array([current], pa.int64()), "a": pa.array([found[0]], pa.list_(pa.int64())), "b": pa.array([found[1]], pa.list_(pa.int64()))})

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            borders = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            for s, e in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                if s == e:
                    continue
                if current is not None and cell[s] != current:
                    yield from flush()
                current = int(cell[s])
                held.append(batch.slice(s, e - s))
        yield from flush()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "cell").sortWithinPartitions("cell", "is_bulk", "node").mapInArrow(search, "cell long, a array<long>, b array<long>")


def _confirmed_in_cells(cells: DataFrame, sets: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """A forest of the links among the pairs of each cell; the sets of a cell's nodes meet in one task."""
    nodes = cells.select("cell", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node"))
    held = nodes.join(sets, "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def confirm(members: pa.Table, pairs: pa.Table) -> pa.Table:
        shingles = {n: np.frombuffer(s, dtype=np.uint64) for n, s in zip(members.column("node").to_pylist(), members.column("shingles").to_pylist(), strict=True)}
        label = dict(zip(members.column("node").to_pylist(), members.column("component").to_pylist(), strict=True))
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = ([], [])
        for a, b in zip(pairs.column("a")[0].as_py() if pairs.num_rows else [], pairs.column("b")[0].as_py() if pairs.num_rows else [], strict=True):
            x, y = find(label[a]), find(label[b])
            if x != y and _alike(shingles[a], shingles[b], percent):
                root[max(x, y)] = min(x, y)
                out[0].append(a), out[1].append(b)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    found = held.select("cell", "node", "shingles", "component").groupBy("cell").cogroup(cells.toDF("of", "a", "b").groupBy("of")).applyInArrow(confirm, "a long, b long")
    return stored(found, "cell-links")


def likely_pairs(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, miss: float):
    """``likely`` over pairs of rows of one array, in pieces of bounded size."""
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for k in range(0, len(i), 16384):
        alive, matches = likely(sketch[i[k: k + 16384]], sketch[j[k: k + 16384]], threshold, miss)
        found.append((alive + k, matches))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle sets.  A null text,
    an empty one and one without words has no shingle and links with nothing.  ``component_id`` is the least id
    that links reach; rows of equal id are judged each by their own text; rows without an id link with
    nothing and have a null component.  Other columns play no part; no rows give no rows.
    """
    threshold = percent / 100
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stored(texts.mapInArrow(_sign, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"), "signatures")
    usable = signed.where("doc_id is not null and set_key is not null")
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "set-classes")
    heads = usable.select("set_key", "doc_id", "bands", "sketch").join(classes, ["set_key", "doc_id"]).dropDuplicates(["node"])
    heads = stored(heads.select("node", "doc_id", "set_key", "bands", "sketch"), "heads")
    banded = heads.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(banded.join(shared, "bucket"), "buckets")
    marks = F.unhex(F.array_join(F.transform("bands", lambda b: F.lpad(F.hex(F.pmod(b, F.lit(1 << 32))), 8, "0")), ""))
    sketches = heads.select("node", "sketch")
    stars = members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    stars = stars.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
    pairs = stored(_survivors(stars, threshold, miss), "pairs")
    links = _confirmed(pairs, _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), heads, texts), percent)
    grouped = stored(components(links), "components")
    rest = members.where("n > 2").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    cells = stored(_across(rest.join(heads.select("node", "sketch", marks.alias("marks")), "node"), threshold, miss), "cells")
    sets = _sets(cells.select(F.explode(F.array_union("a", "b")).alias("node")), heads, texts)
    links = links.unionByName(_confirmed_in_cells(cells, sets, grouped, percent))
    grouped = stored(components(links), "components")
    known = classes.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = known.join(known.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("set_key", "copies", "component_id")
    rows = signed.select("doc_id", "n_shingles", "set_key")
    linked = join_classes(rows.where("doc_id is not null and set_key is not null"), stored(known, "set-components"), "set_key", "copies")
    alone = rows.where("doc_id is null or set_key is null").withColumn("component_id", F.col("doc_id"))
    result = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
