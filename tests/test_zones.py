"""Pages from a store by rank: the right rows, and few files."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import index as I
from shelfmark.operators import search as S
from shelfmark.sources import zones as Z


@pytest.fixture(scope="module")
def stored_index(spark, tmp_path_factory):
    rows = spark.range(3000).select(
        F.col("id").alias("row_index"), F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") % 10 < 8, "tea").otherwise("box").alias("scope"),
        F.when(F.col("id") % 10 < 8, "Tea").otherwise("Box").alias("category"), (F.col("id") % 7).cast("string").alias("brand"), F.xxhash64("id").cast("string").alias("name"))
    ranked = I.with_browse_ranks(rows).cache()
    path = str(tmp_path_factory.mktemp("zones"))
    Z.write_zones(ranked, path, file_rows=150)
    return ranked, path


REQUESTS = [(1, "*", 0, 24), (2, "tea", 2390, 24), (3, "box", 100, 50), (4, "*", 2990, 100), (5, "tea", 100_000, 24), (6, "nope", 0, 24)]


def test_pages_equal_those_of_the_index(spark, stored_index):
    ranked, path = stored_index
    asked = spark.createDataFrame(REQUESTS, "query_id long, scope string, offset int, limit int")
    shown = ["query_id", "rank", "row_index", "id"]
    want = sorted(map(tuple, S.browse_pages(asked, ranked).select(*shown).collect()))
    assert sorted(map(tuple, Z.zone_pages(spark, path, asked).select(*shown).collect())) == want and len(want) == 24 + 10 + 50 + 10


def test_a_page_reads_the_files_that_hold_it(spark, stored_index):
    _, path = stored_index
    whole = len([f for f in spark.read.parquet(f"{path}/rows").inputFiles()])
    assert whole >= 30
    for query, scope, offset, limit in REQUESTS:
        one = spark.createDataFrame([(query, scope, offset, limit)], "query_id long, scope string, offset int, limit int")
        files = Z.zone_files(spark, path, one)
        assert len(files) <= 3
        assert set(f.rsplit("/", 1)[1] for f in Z.zone_rows(spark, path, one).inputFiles()) >= set(files) and len(files) == len(set(files))
        if query in (5, 6):
            assert files == [] and Z.zone_pages(spark, path, one).count() == 0
