"""Connected components of a table of links, as Spark joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import stored


def _least(links: DataFrame) -> DataFrame:
    """Links in both directions with the least neighbour of the first end (combined on the map side)."""
    both = links.union(links.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a")


def _contract(batches):
    """The links of a partition as stars: each node points at the least node that the partition's links reach."""
    parent: dict = {}

    def find(node):
        root = node
        while parent[root] != root:
            root = parent[root]
        while parent[node] != root:
            parent[node], node = root, parent[node]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    ends = [(node, find(node)) for node in parent]
    ends = [(a, b) for a, b in ends if a != b]
    for k in range(0, len(ends), 1 << 16):
        a, b = zip(*ends[k: k + (1 << 16)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _unfinished(links: DataFrame) -> bool:
    """Does a node have two targets, or does a target point on?"""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", F.lit(None).cast("long")))
    seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count("to").alias("out"), F.count(F.lit(1)).alias("all"))
    return not seen.where("low <> high or (out > 0 and all > out)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of a link; ``component`` is the least node that it reaches.

    ``links`` has two columns of whole numbers; order, repeats and self-links do not matter, rows with a null
    end are left out, no rows give no rows.  Each round contracts the links of every partition, then points
    larger neighbours at the least one ("large star") and each node at its least smaller neighbour ("small
    star"); the rounds are about the logarithm of the longest path, and one as a rule.  Rounds end when every
    node points at one node that points nowhere.  All state is in tables in the shared folder.
    """
    links = links.toDF("a", "b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = links.where("a is not null and b is not null and a <> b")
    while True:
        links = stored(links.mapInArrow(_contract, "a long, b long").distinct(), "links")
        if not _unfinished(links):
            break
        large = _least(links).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = small.where("a <> b")
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(links.select("b", "b").distinct())
