"""Scans: raw post snapshots, the published inventory, vectors, assets, manifests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.staging import stage
from shelfmark.schema import INVENTORY, LOOKUP_POST, RAW_POST, VECTOR
from shelfmark.sources.files import path_exists
from shelfmark.sources.json_arrays import read_json_arrays


class InvalidSnapshot(ValueError):
    """A snapshot file is not a list of posts."""


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_posts(spark: SparkSession, path: str, schema: T.StructType = RAW_POST) -> DataFrame:
    """SRC-1: all pages of a snapshot folder, each a list of posts, with ``seq``, the order of the source.

    Pages are cut into tasks by byte ranges, whatever their size.  A page that holds something else raises, at the latest
    when the rows are read.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = stage(read_json_arrays(spark, path).select("seq", F.from_json("text", with_corrupt, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("post")))
    posts = parsed.select("seq", "post.*")
    bad = F.col("_corrupt_record").isNotNull() | F.col("id").isNull()
    message = F.concat(F.lit("not a list of posts: "), F.coalesce(F.substring("_corrupt_record", 1, 80), F.lit("no id")))
    checked = posts.withColumn("id", F.when(bad, F.raise_error(message).cast("long")).otherwise(F.col("id")))
    return checked.drop("_corrupt_record")


def read_post_lines(spark: SparkSession, path: str, schema: T.StructType = RAW_POST) -> DataFrame:
    """SRC-1 for one post per line: large snapshots in this form split into many tasks."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_auxiliary(spark: SparkSession, path: str, schema: T.StructType = LOOKUP_POST) -> DataFrame:
    """SRC-2: a missing lookup snapshot is an empty table; a broken one raises."""
    return read_posts(spark, path, schema) if path_exists(spark, path) else _empty(spark, schema)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: the published inventory (Parquet, or JSON lines with blank lines skipped)."""
    if not path_exists(spark, path):
        return _empty(spark, INVENTORY)
    if path.rstrip("/").endswith((".json", ".jsonl")):
        return spark.read.schema(INVENTORY).json(path)
    return spark.read.schema(INVENTORY).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4."""
    return spark.read.schema(VECTOR).parquet(path) if path_exists(spark, path) else _empty(spark, VECTOR)


_FIXED = "org.apache.spark.input.FixedLengthBinaryInputFormat"


def read_flat_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """SRC-4 for a headerless file of little-endian float32 rows: ``row_index, embedding``.

    The file is cut at row borders, so a large one is read by many tasks, once; a row's index is its place in the file.
    """
    records = spark.sparkContext.newAPIHadoopFile(
        path, _FIXED, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{_FIXED}.recordLength": str(4 * dim)})
    rows = spark.createDataFrame(records, "row_index long, bytes binary")

    def decode(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), dtype="<f4")
            offsets = pa.array(np.arange(0, flat.size + 1, dim, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("row_index"), vectors], ["row_index", "embedding"])

    return rows.mapInArrow(decode, "row_index long, embedding array<float>")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: names and sizes of stored files; their content is never read.

    ``path``: the folder, or a listing of it as a Parquet table of ``path, length`` (a name ending in .parquet), such as stores
    make of folders that are too large to be listed by one machine.
    """
    if path.rstrip("/").endswith(".parquet"):
        files = spark.read.parquet(path).select("path", F.col("length").cast("long").alias("length"))
    else:
        files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-6: a manifest, or no row when it is absent or unreadable."""
    if not path_exists(spark, path):
        return _empty(spark, schema)
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return _empty(spark, schema)
    if len(rows.take(2)) > 1:
        raise InvalidSnapshot(f"more than one manifest under {path}")
    return rows
