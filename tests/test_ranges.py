"""Range digests: the whole from the parts, and exactly the ranges that changed."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import fingerprint as FP


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5000).select(F.col("id").alias("row_index"), F.sha2(F.col("id").cast("string"), 256).alias("t"), F.array("id").alias("l"))


def test_the_whole_follows_from_the_ranges(rows):
    digests = FP.range_digests(rows.repartition(7), "row_index", 3)
    assert FP.whole_fingerprint(digests, "v").first() == FP.fingerprint(rows, "v").first()
    assert FP.whole_fingerprint(digests.limit(0), "v").first() == FP.fingerprint(rows.limit(0), "v").first()


@pytest.mark.parametrize("edit, want", [
    (lambda r: r, []),
    (lambda r: r.withColumn("t", F.when(F.col("row_index") == 4321, "x").otherwise(F.col("t"))), [2160]),
    (lambda r: r.where("row_index not in (0, 7)"), [0, 3]),
    (lambda r: r.unionByName(r.limit(0)).union(r.where("row_index = 9")), [4]),
    (lambda r: r.where("row_index < 4998"), [2499]),
    (lambda r: r.limit(0), list(range(2500))),
])
def test_changed_ranges(rows, edit, want):
    old, new = FP.range_digests(rows, "row_index", 2), FP.range_digests(edit(rows), "row_index", 2)
    got = FP.changed_ranges(old, new, 2).orderBy("leaf").collect()
    assert [r["leaf"] for r in got] == want and all((r["first"], r["after"]) == (2 * r["leaf"], 2 * r["leaf"] + 2) for r in got)
