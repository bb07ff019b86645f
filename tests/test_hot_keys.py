"""Lookups when one set of items, and items without a key, have most of the rows."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalogue as C


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    item = F.struct(F.when(F.col("id") % 10 != 1, F.lit(7)).cast("bigint").alias("key"), F.concat(F.lit("own "), F.col("id").cast("string")).alias("text"))
    rows = spark.range(20_000).withColumn("brand", F.array(item)).withColumn("id", F.col("id"))     # nine of ten have key 7, the rest is free text
    path = str(tmp_path_factory.mktemp("rows") / "t")
    rows.repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def test_every_row_has_its_names(spark, skewed):
    names = spark.createDataFrame([(7, "seven"), (8, "eight")], "key bigint, name string")
    got = C.resolve_lookups(skewed, {"brand": "brands"}, {"brands": names})
    counts = {r["b"]: r["count"] for r in got.groupBy(F.when(F.col("brand") == "seven", "seven").otherwise(F.left("brand", F.lit(4))).alias("b")).count().collect()}
    assert counts == {"seven": 18_000, "own ": 2_000}
    assert got.filter("id = 11").first()["brand"] == "own 11"


def test_no_partition_holds_the_frequent_set(spark, skewed):
    names = spark.createDataFrame([(7, "seven")], "key bigint, name string")
    got = C.resolve_lookups(skewed, {"brand": "brands"}, {"brands": names})
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] < 3 * 20_000 / 4 and sum(s > 1000 for s in sizes) >= 6     # the frequent set's rows stay in the partitions they came in


def test_any_number_of_frequent_keys(spark, skewed, monkeypatch):
    monkeypatch.setattr(C, "HOT", 1)
    names = spark.createDataFrame([(7, "seven")], "key bigint, name string")
    got = C.resolve_lookups(skewed, {"brand": "brands"}, {"brands": names})
    assert got.count() == 20_000 and got.filter("brand = 'seven'").count() == 18_000
