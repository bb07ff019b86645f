"""STR-1: a keyed table kept as sorted runs that are merged step by step, behind a manifest.

Each batch adds a run: the newest row of each of its keys, in ranges of the key.  When a level has ``FAN`` runs they become one
run of the next level, and runs of the last level but one go into the base; so a table has at most ``MOST_RUNS`` runs
whatever number of batches went in, and a row is rewritten a few times only.  ``manifest-<version>.json`` names
the runs that make up the table and the last batch of each writer; it appears by a rename, readers
look at the newest one and at nothing else.  A batch that is replayed finds its number in it and does nothing.

Runs that a merge replaced are removed at the next merge, so that readers of the manifest before may finish.
One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.catalogue import latest_per_key
from shelfmark.sources import files

FAN, LEVELS = 4, 3
MOST_RUNS = (LEVELS - 1) * (FAN - 1) + 1


@dataclass
class Manifest:
    version: int = 0
    schema: str | None = None  # of the rows, as JSON
    runs: list[dict] = field(default_factory=list)  # name, level
    retired: list[str] = field(default_factory=list)  # replaced by the last merge
    batches: dict[str, int] = field(default_factory=dict)  # the last batch of each writer


@dataclass(frozen=True)
class MergedTable:
    """The newest row of each ``key``: greatest ``version``, least ``seq`` on ties.  Fields are Columns over the rows."""

    spark: SparkSession
    path: str
    key: Column
    version: Column
    seq: Column

    def manifest(self) -> Manifest:
        names = sorted(n for n in files.names(self.spark, self.path) if n.startswith("manifest-"))
        return Manifest(**json.loads(files.read_text(self.spark, f"{self.path}/{names[-1]}"))) if names else Manifest()

    def read(self) -> DataFrame:
        """The table as the newest manifest tells it."""
        found = self.manifest()
        if not found.runs:
            raise FileNotFoundError(f"no rows were merged into {self.path}")
        return self._newest(self._rows(found, found.runs))

    def add(self, rows: DataFrame, writer: str, batch: int) -> None:
        """One batch of a writer, once."""
        found = self.manifest()
        if batch <= found.batches.get(writer, -1):
            return
        found.schema = found.schema or rows.schema.json()
        found.runs.append(self._run(self._newest(rows), 0))
        found.batches[writer] = batch
        self._publish(found)
        self.compact()

    def compact(self) -> None:
        """Merge full levels, lowest first."""
        for level in range(LEVELS - 1):
            found = self.manifest()
            merged = [run for run in found.runs if run["level"] == level]
            if len(merged) < FAN:
                return
            if level + 1 == LEVELS - 1:  # the base is one run
                merged += [run for run in found.runs if run["level"] > level]
            run = self._run(self._newest(self._rows(found, merged)), level + 1)
            old, found.retired = found.retired, [r["name"] for r in merged]
            found.runs = [r for r in found.runs if r not in merged] + [run]
            self._publish(found)
            for name in old:
                files.remove(self.spark, f"{self.path}/{name}")

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, self.key, self.version, self.seq)

    def _rows(self, found: Manifest, runs: list[dict]) -> DataFrame:
        from pyspark.sql import types as T

        schema = T.StructType.fromJson(json.loads(found.schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{run['name']}" for run in runs])

    def _run(self, rows: DataFrame, level: int) -> dict:
        name = f"run-{level}-{uuid.uuid4().hex}"
        keyed = rows.withColumn("__key", self.key)
        keyed.repartitionByRange("__key").sortWithinPartitions("__key").drop("__key").write.parquet(f"{self.path}/{name}")
        return {"name": name, "level": level}

    def _publish(self, found: Manifest) -> None:
        found.version += 1
        files.write_text(self.spark, f"{self.path}/manifest-{found.version:012d}.json", json.dumps(asdict(found)))
        for name in files.names(self.spark, self.path):
            if name.startswith("manifest-") and int(name[9:21]) < found.version - 1:
                files.remove(self.spark, f"{self.path}/{name}")
