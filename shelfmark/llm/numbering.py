"""Gapless numbers within groups, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """``df`` with a column ``name``: 0, 1, ... within each group.

    A group is dealt into ``buckets`` parts by a hash of ``order``; rows are numbered in their part
    and moved up by the sizes of the parts before it.
    """
    part: Column = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    keys = [*group, "__part"]
    dealt = df.withColumn("__part", part).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    sizes = df.withColumn("__part", part).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return dealt.join(starts, keys).withColumn(name, F.col("__rank") - 1 + F.col("__before")).drop("__part", "__rank", "__before")
