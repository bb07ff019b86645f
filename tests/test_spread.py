from shelfmark.functions import staging


def test_pieces_grow_in_number_not_in_size(spark, tmp_path):
    spark.range(300_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    cores = spark.sparkContext.defaultParallelism
    assert staging.spread(rows).rdd.getNumPartitions() == cores
    assert staging.spread(rows, 20_000).rdd.getNumPartitions() > 2 * cores
    assert staging.spread(rows, 20_000).count() == 300_000
