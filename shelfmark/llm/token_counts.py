"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a table of the most frequent pre-tokens with their lengths in tokens, at most
``table_size`` entries, broadcast to every task.  Tier two is the cache of each worker: a
pre-token that the table lacks is encoded once and remembered.  Pre-tokens of texts are never
shuffled; only each task's list of at most ``per_task`` frequent ones is, to choose the table.
The table sets the speed alone: any table gives the same counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrays import slices, text_bytes
from shelfmark.llm.encoding import encoder


def frequent_pieces(docs: DataFrame, text: str, path: str, table_size: int, per_task: int) -> list[str]:
    """The pre-tokens most frequent over all texts, by the lists of all tasks."""

    def most(batches):
        def top(table: pa.Table) -> pa.Table:
            if table.num_rows <= 8 * per_task:
                return table
            return table.take(pc.select_k_unstable(table, 8 * per_task, [("n", "descending")]))

        kept = None
        for batch in batches:
            for part in slices(batch, text):
                pieces, _, whole = encoder(path).split(part.column(text))
                if whole.all():
                    continue
                counts = pc.value_counts(pieces)
                found = pa.table([counts.field("values").cast(pa.string()), counts.field("counts")], ["piece", "n"])
                kept = top(found if kept is None else pa.concat_tables([kept, found]).group_by("piece").aggregate([("n", "sum")]).rename_columns(["piece", "n"]))
        if kept is not None:
            kept = kept.take(pc.select_k_unstable(kept, per_task, [("n", "descending")]))
            yield from kept.cast(pa.schema([("piece", pa.string()), ("n", pa.int64())])).to_batches()

    lists = docs.select(F.col(text).cast("string").alias(text)).mapInArrow(most, "piece string, n long")
    totals = lists.groupBy("piece").agg(F.sum("n").alias("n")).where(F.length("piece") <= 64)
    return [row.piece for row in totals.orderBy(F.desc("n"), "piece").limit(table_size).collect()]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096,
                 table_size: int = 16384, per_task: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    Counts are those of the tokenizer library over the whole text, without begin or end tokens.
    A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a null id is
    kept; columns other than the two named play no part, whatever they are called; no rows give no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = frequent_pieces(rows, "text", path, table_size, per_task)
    lengths = [len(ids) for ids in encoder(path).whole([encoder(path).lead + piece for piece in pieces])]
    table = rows.sparkSession.sparkContext.broadcast((pieces, np.array(lengths, dtype=np.int32)))

    def count(batches):
        known, known_lengths = table.value
        known = pa.array(known, pa.large_string())
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(text_bytes(part.column("text"))[1])),
                     pa.array(_count(part.column("text"), known, known_lengths))], ["doc_id", "n_bytes", "n_tokens"])

    def _count(column, known, known_lengths):
        tokenizer = encoder(path)
        pieces, offsets, whole = tokenizer.split(column)
        if not tokenizer.cut:
            return np.fromiter(map(len, tokenizer.whole(column.fill_null("").to_pylist())), dtype=np.int64, count=len(column))
        places = pc.index_in(pieces, value_set=known)
        missing = pc.is_null(places)
        lengths = np.zeros(len(pieces), dtype=np.int64)
        if len(known):
            lengths[:] = known_lengths[pc.fill_null(places, 0).to_numpy()]
        at = np.flatnonzero(missing.to_numpy(zero_copy_only=False))
        coded = pieces.take(pa.array(at)).dictionary_encode()
        found = tokenizer.rest.find(coded.dictionary.to_pylist())
        lengths[at] = tokenizer.rest.lengths[found][coded.indices.to_numpy()]
        if tokenizer.lead:
            first = offsets[:-1]
            lengths[first] = tokenizer.first.lengths[tokenizer.first.find(pieces.take(pa.array(first)).to_pylist())]
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[offsets])
        odd = np.flatnonzero(whole)
        counts[odd] = [len(ids) for ids in tokenizer.whole(column.take(pa.array(odd)).to_pylist())]
        return counts

    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
