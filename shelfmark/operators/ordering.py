"""Exact ranking and top-k that stay distributed when one group holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import stored



def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group.

    A literal bound on ``row_number`` lets Spark cut every partition to ``n`` rows
    per group before the shuffle, so a hot group sends few rows.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def global_rank(df: DataFrame, group: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Exact ``row_number`` per group with no task that sees a whole group.

    Rows are cut into ranges of (group, order), as many as the session's shuffles have; they are
    numbered inside their range and moved up by the sizes of the group's earlier ranges.  The ranges
    only steer the work: any choice gives the same ranks.  ``order`` must end in a unique column.
    Nulls sort first, as in ``orderBy``.
    """
    keys = [F.col(c) for c in group + order]
    dealt = stored(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    numbered = dealt.withColumn("__within", F.row_number().over(inside))
    sizes = dealt.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # one row per range
    earlier = earlier.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    on = [numbered["__part"] == shifts["__part"]] + [numbered[g].eqNullSafe(shifts[g]) for g in group]
    columns = [numbered[c] for c in df.columns]
    return numbered.join(shifts, on).select(*columns, (F.col("__within") + F.col("__shift")).alias(rank))


def page_slots(requests: DataFrame) -> DataFrame:
    """One row per wanted rank of each request; a page is at most the clamped limit long."""
    wanted = F.sequence(F.col("offset") + 1, F.col("offset") + F.col("limit"))
    return requests.withColumn("rank", F.explode(wanted))
