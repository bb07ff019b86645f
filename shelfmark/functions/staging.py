"""Step boundaries inside a projection-only plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, which the optimiser does not merge projections across.

    Without it a chain of selects collapses into one, and every use of a costly
    column repeats its whole expression.  One row in, one row out, no shuffle.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{name}`") for name in df.columns]))))


SPREAD_BELOW = 64 << 20  # bytes per core
SPREAD_PIECE = 1 << 20  # bytes of files in one task


def spread(df: DataFrame, piece: int = SPREAD_PIECE) -> DataFrame:
    """Rows of a small input over all cores, in tasks of about ``piece`` bytes; a large input is left as it is read.

    Small files come in one or two row groups and would keep one core busy, and tasks as many as
    cores would grow with the input.  The size is the optimiser's estimate, so this runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // piece))) if size < SPREAD_BELOW * cores else df
