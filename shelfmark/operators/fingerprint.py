"""Content fingerprint of a table that does not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNKS = 8  # 8 x 32 bits of a 256-bit row digest


def row_text(columns: list[str]) -> Column:
    """A row as text: every value with its length, so that neighbours cannot run together."""
    parts = []
    for name in columns:
        text = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *parts)


def _numbers(rows: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """The row digests as eight numbers; composite columns are read as JSON."""
    flat = rows.select(*more, *[
        F.to_json(name).alias(name) if dict(rows.dtypes)[name].startswith(("array", "map", "struct")) else F.col(name)
        for name in names
    ])
    kept = [F.col(c) for c in flat.columns[: len(more)]]
    digest = flat.select(*kept, F.sha2(row_text(names), 256).alias("h"))
    return digest.select(*kept, *[
        F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)").alias(f"n{i}") for i in range(_CHUNKS)
    ])


def _sums(count: Column) -> list[Column]:
    return [count.alias("rows"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"n{i}") for i in range(_CHUNKS)]]


def _digest(version: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(f"n{i}").cast("string") for i in range(_CHUNKS)], F.col("rows").cast("string"), F.lit(version)), 256)


def fingerprint(rows: DataFrame, version: str, columns: list[str] | None = None) -> DataFrame:
    """HSH-2: sha256 over the sums of the row digests, the row count and ``version``.

    Sums combine on the map side, so no task holds more than a few numbers.
    """
    sums = _numbers(rows, columns or rows.columns).agg(*_sums(F.count("*")))
    return sums.select(_digest(version).alias("fingerprint"), "rows")


# ---------------------------------------------------------------- ranges

FANOUT = 1024  # leaves of a node


def range_digests(rows: DataFrame, position: str, range_rows: int, columns: list[str] | None = None) -> DataFrame:
    """HSH-2 by ranges of ``position``: ``leaf, rows, n0 … n7``, the sums of the rows of each range.  Store it with the table."""
    leaf = F.floor(F.col(position) / range_rows).cast("bigint").alias("leaf")
    return _numbers(rows, columns or rows.columns, leaf).groupBy("leaf").agg(*_sums(F.count("*")))


def whole_fingerprint(digests: DataFrame, version: str) -> DataFrame:
    """What ``fingerprint`` gives for the whole table, from the digests of its ranges."""
    return digests.agg(*_sums(F.coalesce(F.sum("rows"), F.lit(0)))).select(_digest(version).alias("fingerprint"), "rows")


def changed_ranges(before: DataFrame, after: DataFrame, range_rows: int) -> DataFrame:
    """``leaf, first, after``: ranges of ``position`` whose rows are not the same in two states of a table.

    Nodes of FANOUT leaves are compared first, and leaves only below nodes that differ.
    """
    c, node = F.col, F.floor(F.col("leaf") / FANOUT).alias("node")

    def differing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
        told = [d.select(key, _digest("").alias(name)) for d, name in ((old, "old"), (new, "new"))]
        return told[0].join(told[1], key, "full").where(~c("old").eqNullSafe(c("new"))).select(key)

    nodes = [d.groupBy(node).agg(*_sums(F.sum("rows"))) for d in (before, after)]
    below = F.broadcast(differing(*nodes, "node"))  # one row for FANOUT ranges at most
    leaves = [d.withColumn("node", node).join(below, "node", "left_semi").drop("node") for d in (before, after)]
    return differing(*leaves, "leaf").select("leaf", (c("leaf") * range_rows).alias("first"), ((c("leaf") + 1) * range_rows).alias("after"))
