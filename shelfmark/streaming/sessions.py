"""STR-2: which requests of a stream are the latest of their session, with state that expires."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Spark starts the processor also in a Python process beside the driver, which has no file that was sent to the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = "spark.sql.streaming.stateStore"
STORE = {  # what a query with such a state needs while it starts; its many small stores reserve no disk ahead
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}
_SESSIONS = 1 << 16  # that a task holds before it hands on what it has


class LatestRequest(StatefulProcessor):
    """Hands on a session's request when it is newer than all before it.

    A session is known by the number of its last request.  It is forgotten ``ttl_ms`` after that, by a timer on the stream's
    watermark, so the state holds the sessions of that time only.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "seq long, until long")  # until: milliseconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, at = None, 0
        for part in rows:
            row = part.loc[[part["seq"].idxmax()]]
            if self.ttl_ms is not None:
                at = max(at, int(part["asked_at"].max().timestamp() * 1000))
            if best is None or row["seq"].iloc[0] > best["seq"].iloc[0]:
                best = row
        if best is None:
            return
        seq, until = int(best["seq"].iloc[0]), at + (self.ttl_ms or 0)
        old = self.known.get() if self.known.exists() else None
        if self.ttl_ms is not None:
            if old is not None:
                self.handle.deleteTimer(old[1])
                until = max(until, old[1])
            self.handle.registerTimer(until)
        self.known.update((seq if old is None else max(seq, old[0]), until))
        if old is None or seq > old[0]:
            yield best

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest request of each session of a partition, with the time of its last one."""
    held: pa.Table | None = None

    def reduced(table: pa.Table) -> pa.Table:
        order = table.append_column("__row", pa.array(np.arange(table.num_rows))).sort_by(
            [("session", "ascending"), ("seq", "descending"), ("__row", "ascending")])
        session = order["session"].combine_chunks()
        change = pc.not_equal(session.slice(1), session.slice(0, len(session) - 1)).to_numpy(zero_copy_only=False)
        best = order.filter(pa.array(np.concatenate([[True], change]))).select(table.column_names)
        if "asked_at" not in best.column_names:
            return best
        last = table.group_by("session", use_threads=False).aggregate([("asked_at", "max")]).sort_by("session")
        return best.set_column(best.column_names.index("asked_at"), table.schema.field("asked_at"), last["asked_at_max"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = reduced(table if held is None else pa.concat_tables([held, table]))
        if held.num_rows > _SESSIONS:
            yield from held.combine_chunks().to_batches()
            held = None
    if held is not None:
        yield from held.combine_chunks().to_batches()


def latest_requests(stream: DataFrame, ttl_ms: int, delay: str) -> DataFrame:
    """The requests of a stream that are newer than all earlier ones of their session.

    ``stream``: ``session, seq, ...`` and perhaps ``asked_at`` (timestamp).  Of a batch only the newest request of a session
    is handed on; each task reduces its own first, so that a busy session sends one row.  Rows without session,
    number or (if there is one) time are not requests.  ``asked_at`` may be late by ``delay``; what is
    later is left out.  Without it no time passes, and no session is forgotten.
    """
    timed = "asked_at" in stream.columns
    told = stream.where("session is not null and seq is not null").withColumn("seq", F.col("seq").cast("long"))
    if timed:
        told = told.withColumn("asked_at", F.col("asked_at").cast("timestamp")).where("asked_at is not null")
    reduced = told.mapInArrow(_newest, told.schema)
    reduced = reduced.withWatermark("asked_at", delay) if timed else reduced
    processor = LatestRequest(ttl_ms if timed else None)
    return reduced.groupBy("session").transformWithStateInPandas(processor, told.schema, "Append", "EventTime" if timed else "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The settings of STORE, for queries started inside."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def known_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that a stopped stream knows."""
    with state_store(spark):
        return spark.read.format("statestore").option("stateVarName", "known").load(checkpoint)
