"""SNK-7: vectors written in commits of row ranges, and the log that tells which of them are finished.

A build's rows are numbered by ``row_index``.  Each commit writes the vectors of some range to a folder
of its own and then adds one line to the log; readers follow the log, so what a broken commit left
behind is never read, and the next commit of that number replaces it.  Nothing that is logged is lost when a later
commit, the driver or an executor fails.  One builder at a time writes to a folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import vectors as VX
from shelfmark.schema import VECTOR
from shelfmark.sources.files import path_exists

_LOG = "number long, first long, after long, rows long, complete boolean"


@dataclass(frozen=True)
class Commit:
    number: int
    first: int  # row_index
    after: int
    rows: int
    complete: bool  # every vector is complete, so the range need not be looked at again


@dataclass(frozen=True)
class CommitLog:
    """The commits of one build under ``folder/build=<build>``."""

    spark: SparkSession
    folder: str
    build: str

    def commits(self) -> list[Commit]:
        """Finished commits, oldest first; there is one for each ``commit_rows`` rows of a build."""
        path = f"{self.folder}/_log/build={self.build}"
        if not path_exists(self.spark, path):
            return []
        return sorted((Commit(*row) for row in self.spark.read.schema(_LOG).json(path).collect()), key=lambda c: c.number)

    def ranges(self) -> list[tuple[int, int]]:
        """Complete ranges, neighbours joined."""
        joined: list[tuple[int, int]] = []
        for first, after in sorted((c.first, c.after) for c in self.commits() if c.complete):
            if joined and first <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(after, joined[-1][1]))
            else:
                joined.append((first, after))
        return joined

    def outside(self, rows: DataFrame) -> DataFrame:
        """The rows in no complete range: the complement of the log, told to the scan as bounds of ``row_index``."""
        for first, after in self.ranges():
            rows = rows.where((F.col("row_index") < first) | (F.col("row_index") >= after))
        return rows

    def commit(self, vectors: DataFrame, first: int, after: int, dim: int) -> Commit:
        """Write ``row_index, id, text_hash, embedding`` of one range; it counts once the log has its line."""
        number = len(self.commits())
        path = self._path(number)
        vectors.select("row_index", "id", "text_hash", "embedding").write.mode("overwrite").parquet(path)
        rows, complete = self.spark.read.parquet(path).agg(
            F.count("*"), F.count_if(VX.is_complete(F.col("embedding"), dim))).first()
        done = Commit(number, first, after, rows, rows == complete)
        line = self.spark.createDataFrame([(done.number, first, after, rows, done.complete)], _LOG)
        line.coalesce(1).write.mode("append").json(f"{self.folder}/_log/build={self.build}")
        return done

    def _path(self, number: int) -> str:
        return f"{self.folder}/build={self.build}/commit={number:06d}"


def read_committed(spark: SparkSession, folder: str) -> DataFrame:
    """Every finished vector of every build under ``folder``: ``id, text_hash, embedding``."""
    empty = spark.createDataFrame([], VECTOR)
    if not path_exists(spark, f"{folder}/_log"):
        return empty
    lines = spark.read.schema(f"{_LOG}, build string").json(f"{folder}/_log").select("build", "number").collect()  # one row a commit
    paths = [CommitLog(spark, folder, row["build"])._path(row["number"]) for row in lines]
    return spark.read.schema(VECTOR).parquet(*sorted(paths)) if paths else empty


def plan_commits(pieces: DataFrame, commit_rows: int, shard_rows: int = 1_000_000) -> list[tuple[int, int, int]]:
    """``(first, after, rows)`` of ranges that hold about ``commit_rows`` undone rows each.

    ``pieces``: the runs ``start, end`` of WIN-2, none longer than ``commit_rows``.  Their running sum is taken per shard
    of consecutive rows and moved up by the shards before it; one row a commit reaches the driver.
    """
    c = F.col
    sized = pieces.select("start", "end", (c("end") - c("start")).alias("n"), F.floor(c("start") / shard_rows).alias("shard"))
    before = _before("shard")
    shards = sized.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    placed = sized.join(F.broadcast(shards), "shard").withColumn("above", c("before") + F.coalesce(_before("start", "shard"), F.lit(0)))
    commits = placed.groupBy(F.floor(c("above") / commit_rows).alias("commit")).agg(
        F.min("start").alias("first"), F.max("end").alias("after"), F.sum("n").alias("rows"))
    return [(row["first"], row["after"], row["rows"]) for row in commits.orderBy("first").collect()]


def _before(order: str, *group: str) -> Column:
    return F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
