"""Streaming forms of the upsert, latest-request and incremental-embedding jobs.

Each stream runs on any trigger; ``availableNow`` drains what is there and stops.
The sinks are tables on shared storage, written per batch, so neither the driver
nor one task holds the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.catalogue import latest_per_key  # noqa: F401  the batch form of STR-1
from shelfmark.operators.embedding import TextsToVectors, embed_column, missing_rows
from shelfmark.session import stored
from shelfmark.sources.merged import MergedTable
from shelfmark.sources.readers import read_vectors
from shelfmark.sources.writers import append_vectors
from shelfmark.streaming.sessions import latest_requests, state_store


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict, mode="append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(each).trigger(**trigger).start()


def upsert_stream(
    stream: DataFrame, key, version, seq, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """STR-1: each batch is merged into the table under ``out``, which holds the newest row of each key.

    The table is its own state: a batch adds the newest row of each of its keys as a run, and runs are merged now and then.
    """
    table = MergedTable(stream.sparkSession, out, key, version, seq)
    return _start(stream, lambda rows, batch: table.add(rows, checkpoint, batch), checkpoint, trigger or {"availableNow": True})


def read_upserts(spark, out: str, key, version, seq) -> DataFrame:
    """The current table of ``upsert_stream``."""
    return MergedTable(spark, out, key, version, seq).read()


DAY_MS = 24 * 3600 * 1000


def latest_request_stream(
    stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, trigger: dict | None = None,
    ttl_ms: int = DAY_MS, delay: str = "1 hour",
) -> StreamingQuery:
    """STR-2: only the latest request of each session is answered; earlier ones are superseded.

    ``stream``: ``session, seq, q, category, offset, limit`` and perhaps ``asked_at``.  ``answer``, which may be ``search``, gets
    the requests of a batch numbered by ``query_id`` (long) and returns it with each row; the log has
    ``session`` and ``seq`` instead.  A session is forgotten ``ttl_ms`` after its last request.
    """

    def write(latest: DataFrame, batch: int) -> None:
        requests = stored(latest.withColumn("query_id", F.monotonically_increasing_id()), "requests")
        if requests.isEmpty():
            return
        asked = requests.select("query_id", "session", "seq")
        answered = answer(requests.drop("session", "seq", "asked_at")).join(asked, "query_id").drop("query_id")
        answered.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with state_store(stream.sparkSession):
        return _start(latest_requests(stream, ttl_ms, delay), write, checkpoint, trigger or {"availableNow": True})


def embedding_stream(
    stream: DataFrame, vectors_path: str, model: TextsToVectors, dim: int, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """STR-3: embeds only rows (``id, record_text, text_hash``) without a vector of the same text."""

    def write(rows: DataFrame, batch: int) -> None:
        unique = rows.dropDuplicates(["id", "text_hash"])
        todo = missing_rows(unique, read_vectors(rows.sparkSession, vectors_path), dim)
        append_vectors(embed_column(todo, "record_text", "embedding", model, dim), vectors_path)

    return _start(stream, write, checkpoint, trigger or {"availableNow": True})
