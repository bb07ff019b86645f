"""Maintenance of the embedding table: which rows miss a vector, and filling them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as X
from shelfmark.functions import vectors as VX

TextsToVectors = Callable[[list[str]], np.ndarray]
_ASCII_WORD = re.compile(r"[^\t\n\f\r ]+")


# ---------------------------------------------------------------- VEC-7

def hashing_model(dim: int) -> TextsToVectors:
    """The default model: weighted word counts in ``dim`` hash buckets.

    Pure, so tasks can be retried.  Weights are positive: words cannot cancel out,
    so every text with a word has a vector.  In a text of Unicode space alone, all but ASCII space counts as words.
    """

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for row, text in enumerate(texts):
            for word in text.lower().split() or _ASCII_WORD.findall(text):
                code = zlib.crc32(word.encode())
                out[row, code % dim] += 1.0 + (code >> 24) / 255
        return out

    return embed


def embed_column(df: DataFrame, text: str, vector: str, model: TextsToVectors, dim: int, batch: int = 64) -> DataFrame:
    """Adds ``vector``: unit vectors of ``text`` (null: empty), computed in batches of at most ``batch`` rows.

    A model that returns the wrong shape fails the task; Spark retries it.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != vector] + [
        T.StructField(vector, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                got = np.asarray(model([told or "" for told in part.column(text).to_pylist()]), dtype=np.float64)
                if got.shape != (part.num_rows, dim):
                    raise ValueError(f"model returned {got.shape}, expected {(part.num_rows, dim)}")
                got = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
                values = pa.array(got.astype(np.float32).ravel())
                offsets = pa.array(np.arange(0, got.size + 1, dim, dtype=np.int32))
                columns = [part.column(n) for n in part.schema.names if n != vector]
                names = [n for n in part.schema.names if n != vector]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, values)], [*names, vector])

    return df.mapInArrow(run, schema)


def embedder(model: TextsToVectors, dim: int, batch: int = 64):
    """The form ``search`` takes: ``embed(table, text column, vector column)``."""
    return lambda df, text, vector: embed_column(df, text, vector, model, dim, batch)


def response_vectors(responses: DataFrame, dim: int) -> DataFrame:
    """VEC-8: one row per vector of recorded embedding responses, unit length.

    ``responses``: ``response_id, payload``.  A response without vectors, or with one
    of the wrong size, gives one row with ``error``.
    """
    parsed = responses.select("response_id", VX.payload_vectors(F.col("payload")).alias("vectors"))
    rows = parsed.select("response_id", F.posexplode_outer("vectors").alias("position", "vector"))
    error = F.when(F.col("position").isNull(), F.lit("no vectors")).when(
        F.coalesce(F.size("vector") != dim, F.lit(True)), F.lit("wrong size"))
    return rows.withColumn("error", error).withColumn(
        "vector", F.when(F.col("error").isNull(), VX.unit_or_zero(F.col("vector"))))


# ---------------------------------------------------------------- JN-5, JN-6, WIN-2, AGG-4

def with_text_hash(rows: DataFrame, text: str = "record_text") -> DataFrame:
    return rows.withColumn("text_hash", F.sha2(F.col(text), 256))


def missing_rows(texts: DataFrame, vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """JN-5: rows of ``id, text_hash`` without a complete vector of the same text; nulls are equal."""
    return texts.join(embedded(vectors, dim), same_text(), "left_anti")


def embedded(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``done_id, done_hash`` of each complete vector, to be joined by ``same_text``."""
    c = F.col
    return vectors.filter(VX.is_complete(c("embedding"), dim)).select(c("id").alias("done_id"), c("text_hash").alias("done_hash"))


def same_text() -> list[Column]:
    return [F.col("id").eqNullSafe(F.col("done_id")), F.col("text_hash").eqNullSafe(F.col("done_hash"))]


def missing_batches(mask: DataFrame, batch: int, shard_rows: int = 1_000_000) -> DataFrame:
    """WIN-2: runs of undone rows cut into ``[start, end)`` pieces of at most ``batch`` rows.

    ``mask``: ``row_index, done``.  Runs are found per shard of ``shard_rows``
    consecutive rows, so no task sees all rows; a run over a shard border is cut there.
    """
    c = F.col
    shard = F.floor(c("row_index") / shard_rows)
    todo = mask.filter(~c("done")).select(shard.alias("shard"), "row_index")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("row_index"))
    runs = todo.withColumn("run", c("row_index") - place).groupBy("shard", "run").agg(
        F.min("row_index").alias("first"), (F.max("row_index") + 1).alias("after")
    )
    starts = F.explode(F.sequence("first", c("after") - 1, F.lit(batch).cast("bigint")))
    pieces = runs.withColumn("start", starts)
    return pieces.select("start", F.least(c("after"), c("start") + batch).alias("end"))


def progress(texts: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """AGG-4: how many rows have a complete vector of their current text."""
    done = vectors.filter(VX.is_complete(F.col("embedding"), dim)).select("id", "text_hash").distinct()
    marked = texts.select("id", "text_hash").join(done.withColumn("done", F.lit(True)), ["id", "text_hash"], "left")
    return marked.agg(
        F.count_if("done").alias("completed"), F.count_if(F.col("done").isNull()).alias("remaining"),
        F.lit(dim).alias("dim"),
    )


def config_matches(state: DataFrame, config: DataFrame) -> bool:
    """JN-6: every configured value equals the stored one.  Both hold one row."""
    if set(config.columns) - set(state.columns):
        return False
    a, b = state.alias("s"), config.alias("c")
    same = [F.col(f"s.{n}").eqNullSafe(F.col(f"c.{n}")) for n in config.columns]
    return a.join(b, same, "left_semi").count() > 0


def empty_texts(texts: DataFrame, text: str = "record_text") -> DataFrame:
    return texts.filter(X.strip_space(F.coalesce(F.col(text), F.lit(""))) == "")
