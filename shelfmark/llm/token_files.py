"""Token ids in bit-packed blocks, written in ascending document order and read back by numpy.

A written table has one row per block:

    part      int     range of document ids, ascending; one file each
    block     long    number of the block within its part
    doc_ids   array   ids of the block's documents, ascending
    offsets   array   where each document's ids begin in the block, and their count at the end
    bits      int     width of an id: the least that holds the vocabulary
    payload   binary  ids of ``bits`` bits each, one after another, lowest bit first

``payload`` bit ``bits * k`` begins id k, so any id of a block is found without unpacking the
others, and a run of ids unpacks in a few numpy steps.  Spark's writer commits whole tasks, so
a lost executor leaves no half-written part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.arrays import slices
from shelfmark.llm.encoding import encoder

BLOCK = 1 << 18  # ids in a block, unless one document has more


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits as a bit stream."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    columns = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(columns[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from id ``start`` on (uint32); only the bytes that hold them are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=count, offset=start * bits // 8).astype(np.uint32)
    first = start * bits
    data = np.frombuffer(payload, dtype=np.uint8, count=(first + count * bits + 7) // 8 - first // 8, offset=first // 8)
    stream = np.unpackbits(data, bitorder="little")[first % 8: first % 8 + count * bits].reshape(count, bits)
    full = np.zeros((count, 32), dtype=np.uint8)
    full[:, :bits] = stream
    return np.packbits(full, axis=1, bitorder="little").reshape(-1).view("<u4").astype(np.uint32)


_SCHEMA = "part int, block long, doc_ids array<long>, offsets array<long>, bits int, payload binary"


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                      block: int = BLOCK) -> None:
    """Encode every whole text, append ``end_id``, and write the blocks to ``folder``.

    A null or empty text has the end id alone.  Rows without an id come first, in one order of
    their own; rows of equal id stand side by side, each with its own ids.  Other columns play no
    part.  No rows write no block.
    """
    bits = max(1, int(encoder(path).size - 1).bit_length())
    assert end_id < 1 << bits
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    partitions = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def pack(batches):
        held_ids, held_docs, held_counts, part, number = [], [], [], 0, 0

        def block_row():
            nonlocal number
            ids = np.concatenate(held_ids)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(held_counts))])
            docs_in = pa.concat_arrays(held_docs).to_pylist()
            row = {"part": [part], "block": [number], "doc_ids": [docs_in], "offsets": [offsets.tolist()], "bits": [bits], "payload": [pack_bits(ids, bits)]}
            number += 1
            held_ids.clear(), held_docs.clear(), held_counts.clear()
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        size = 0
        for batch in batches:
            for piece in slices(batch, "text"):
                part = piece.column("part")[0].as_py()
                ids, offsets = encoder(path).encode(piece.column("text"))
                n = piece.num_rows
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(n + 1)
                row = 0
                while row < n:  # as many documents as fit the open block, one at least when it is empty
                    last = int(np.searchsorted(offsets, offsets[row] + block - size, side="right")) - 1
                    if last <= row and not size:
                        last = row + 1
                    if last > row:
                        held_ids.append(ids[offsets[row]: offsets[last]])
                        held_docs.append(piece.column("doc_id").slice(row, last - row))
                        held_counts.append(np.diff(offsets[row: last + 1]))
                        size += int(offsets[last] - offsets[row])
                        row = last
                    if row < n:
                        yield block_row()
                        size = 0
        if size:
            yield block_row()

    ordered.mapInArrow(pack, _SCHEMA).write.option("compression", "zstd").parquet(folder)


_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
                    ("bits", pa.int32()), ("payload", pa.binary())])


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` per document, from the files of ``folder``.

    ``start`` counts the ids of all documents before it.  The sums per part that this needs are one
    small row per file; within a part, blocks are few and numbered.
    """
    blocks = spark.read.parquet(folder)
    sizes = blocks.select("part", "block", F.element_at("offsets", -1).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("block_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "block", (F.col("part_start") + F.col("block_start")).alias("start"))

    def unpack(batches):
        import zlib

        for batch in batches:
            for row in batch.to_pylist():
                offsets = np.array(row["offsets"], dtype=np.int64)
                ids = unpack_bits(row["payload"], row["bits"], 0, int(offsets[-1]))
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(offsets[:-1] + row["start"]),
                           "n_tokens": pa.array(np.diff(offsets)), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.join(starts, ["part", "block"]).select("start", "doc_ids", "offsets", "bits", "payload").mapInArrow(
        unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_ids(spark: SparkSession, folder: str, doc_id: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """Random access: ids ``start ..`` of one document; only the payload of its block is unpacked, and there from its first id on.

    No ids if no document has this id; those of the first in the order of the files if several have it.
    """
    held = spark.read.parquet(folder).where(F.array_contains("doc_ids", doc_id))
    row = held.orderBy("part", "block").select("offsets", "bits", "payload", F.array_position("doc_ids", doc_id).alias("at")).head()
    if row is None:
        return np.zeros(0, dtype=np.uint32)
    first, end = row.offsets[row.at - 1], row.offsets[row.at]
    return unpack_bits(bytes(row.payload), row.bits, first + start, max(0, end - first - start if count is None else min(count, end - first - start)))
