"""SRT-2, SNK-1: the catalogue stored by rank, with a map of which file holds which ranks.

A place is the whole catalogue or one category.  Rows of each place stand in the order of their rank, in ranges: a file holds a
run of ranks of some places.  The map has, for each file and place, the first and the last rank, so a page is
found in the one or two files that hold it, whatever the offset, and nothing else is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.index import WHOLE
from shelfmark.operators.ordering import page_slots

FILE_ROWS = 1 << 20
MOST_FILES = 10_000  # read for one batch of requests by name; for more the whole table is read


def write_zones(index: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """``index``: ``row_index, id, scope`` with the ranks of ``with_browse_ranks``; both orders go to ``path/rows``, the map to ``path/zones``."""
    c = F.col
    places = F.array(F.struct(F.lit(WHOLE).alias("scope"), c("browse_rank").alias("rank")), F.struct(c("scope"), c("category_rank").alias("rank")))
    ranked = index.select("row_index", "id", F.explode(places).alias("place")).select("place.scope", "place.rank", "row_index", "id")
    ranges = -(-2 * index.count() // file_rows) or 1
    ordered = ranked.repartitionByRange(ranges, "scope", "rank").sortWithinPartitions("scope", "rank")
    ordered.write.mode("overwrite").parquet(f"{path}/rows")
    told = index.sparkSession.read.parquet(f"{path}/rows").groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "scope")
    told.agg(F.min("rank").alias("first"), F.max("rank").alias("last")).write.mode("overwrite").parquet(f"{path}/zones")


def zone_files(spark: SparkSession, path: str, requests: DataFrame) -> list[str]:
    """Names of the files that hold a rank of some request's page (``scope, offset, limit``)."""
    c = F.col
    asked = requests.select("scope", (c("offset") + 1).alias("a"), (c("offset") + c("limit")).alias("b"))
    zones = spark.read.parquet(f"{path}/zones")
    met = zones.join(asked, "scope").filter((c("first") <= c("b")) & (c("last") >= c("a")))
    return [row["file"] for row in met.select("file").distinct().limit(MOST_FILES + 1).collect()]


def zone_rows(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """The stored rows of the files that the requests need."""
    files = zone_files(spark, path, requests)
    rows = spark.read.schema("scope string, rank long, row_index long, id string")
    if not files:
        return rows.parquet(f"{path}/rows").limit(0)
    return rows.parquet(*([f"{path}/rows"] if len(files) > MOST_FILES else [f"{path}/rows/{name}" for name in files]))


def zone_pages(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """SRT-2: ``query_id, scope, rank, row_index, id`` of each request's page; ``requests``: ``query_id, scope, offset, limit``."""
    asked = requests.select("query_id", "scope", "offset", "limit")
    slots = page_slots(asked).withColumn("rank", F.col("rank").cast("long"))
    return slots.join(zone_rows(spark, path, asked), ["scope", "rank"]).select("query_id", "scope", "rank", "row_index", "id")
