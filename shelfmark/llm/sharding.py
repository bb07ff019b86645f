"""Shards by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are sorted by size, largest first, and each enters the bin whose remaining
room it fills best, found in a balanced tree.  Only the histogram of group sizes is packed on the
driver: sizes below 4096 bytes are exact, larger ones are rounded up to 11 binary digits, so it
has at most about 100,000 entries whatever the data, and a bin never exceeds its capacity.
Groups of one size are numbered in parallel and take their bins by number.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.numbering import numbered
from shelfmark.llm.skew import join_classes
from shelfmark.session import stored

DIGITS = 11


class Rooms:
    """Bins by remaining room in a treap: the tightest room of at least a given size in logarithmic time."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _priority(key) -> int:
        return hash((key, 0x9E3779B9)) & 0xFFFFFFFF

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            return (node[0], node[1], node[2], left), right
        left, right = self._split(node[2], key)
        return left, (node[0], node[1], right, node[3])

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] >= b[1]:
            return a[0], a[1], a[2], self._join(a[3], b)
        return b[0], b[1], self._join(a, b[2]), b[3]

    def add(self, room: int, number: int) -> None:
        left, right = self._split(self.root, (room, number))
        key = (room, number)
        self.root = self._join(self._join(left, (key, self._priority(key), None, None)), right)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the tightest ``(room, number)`` with room for ``least``."""
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= least:
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            left, right = self._split(self.root, found)
            _, right = self._split(right, (found[0], found[1] + 1))
            self.root = self._join(left, right)
        return found


def best_fit(histogram: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """Runs ``(size, groups, bin)`` and the number of bins for ``(size, groups)`` entries of distinct sizes.

    None if a group exceeds the capacity or more than ``most`` bins are needed.  Equal sizes are placed
    together, as one after another they would follow the same bin until it has no room.
    """
    rooms, runs, bins = Rooms(), [], 0
    for size, groups in sorted(histogram, reverse=True):
        if size > capacity:
            return None
        while groups:
            found = rooms.take(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            room, number = found
            fit = min(groups, room // size)
            runs.append((size, fit, number))
            rooms.add(room - fit * size, number)
            groups -= fit
    return runs, bins


def least_capacity(histogram: list[tuple[int, int]], shards: int) -> int:
    """A capacity with which best fit needs at most ``shards`` bins, close to the least."""
    total = sum(size * groups for size, groups in histogram)
    low = max(-(-total // shards), max((size for size, _ in histogram), default=1), 1)
    if best_fit(histogram, low, shards):
        return low
    step = 1
    while not best_fit(histogram, low + step, shards):
        step *= 2
    low, high = low + step // 2, low + step
    while high - low > max(1, high >> 20):
        middle = (low + high) // 2
        low, high = (low, middle) if best_fit(histogram, middle, shards) else (middle, high)
    return high


def even_bins(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs ``(size, groups, bin)`` for ``shards`` bins as even as best fit makes them.

    A group above an even share has a bin to itself, and the others share the rest.
    """
    left, total, alone, rest = shards, sum(size * groups for size, groups in histogram), [], []
    for size, groups in sorted(histogram, reverse=True):
        while groups and left > 1 and size * left > total:
            alone.append((size, 1, len(alone)))
            groups, left, total = groups - 1, left - 1, total - size
        if groups:
            rest.append((size, groups))
    packed, _ = best_fit(rest, least_capacity(rest, left), left)
    return alone + [(size, groups, number + len(alone)) for size, groups, number in packed]


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row.

    Give ``shards`` (as even as best fit makes them) or ``capacity`` (as few shards as best fit needs; a
    group above it raises).  ``size`` is the UTF-8 length plus 8.  Rows of equal text share a shard; null
    counts as the empty text.  ``slot`` is gapless from 0 in a shard.  Rows of equal or null id are placed
    each; other columns play no part; no rows give no rows.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("text_key")), "shard-rows")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2("bytes")) - DIGITS))
    groups = stored(groups.withColumn("class", (F.ceil(F.col("bytes") / step) * step).cast("long")), "shard-groups")
    histogram = [(row["class"], row["n"]) for row in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]
    if capacity is None:
        placed = even_bins(histogram, shards)
    elif (packed := best_fit(histogram, capacity)) is None:
        raise ValueError(f"a group of equal texts exceeds the capacity of {capacity} bytes")
    else:
        placed = packed[0]
    runs, at = [], {}
    for size, fit, number in placed:
        runs.append((size, at.get(size, 0), at.get(size, 0) + fit, number))
        at[size] = at.get(size, 0) + fit
    runs = spark.createDataFrame(runs, "class long, low long, high long, shard int")
    placed = numbered(groups, ["class"], ["text_key"], "number", parts).join(F.broadcast(runs), "class").where("number >= low and number < high").select("text_key", "n", "shard")
    placed = stored(placed, "shard-placed")
    dealt = stored(join_classes(rows, placed, "text_key", "n"), "shard-dealt")
    slots = numbered(dealt, ["shard"], ["doc_id", "text_key"], "slot", parts)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
