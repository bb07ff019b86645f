"""A join from rows to their classes that holds when one class has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000  # classes with more than one row in HOT are broadcast: there are fewer than HOT of them


def join_classes(rows: DataFrame, classes: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` joined with the one class of their ``key``; ``copies`` counts the rows of a class.

    Both should be stored, as each is read twice.  Rows of frequent classes are joined by broadcast
    and never shuffled by their key.
    """
    hot = F.col(copies) * HOT > rows.count()
    often = classes.where(hot)
    frequent = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(classes.where(~hot), key)
    return frequent.unionByName(rest)
