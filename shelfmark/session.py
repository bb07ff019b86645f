"""Session helpers: defaults for a local run, and the shared working folder of a cluster."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks.  A cluster brings its own session instead."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfmark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own: dict[str, str] = {}  # of local sessions without a shared folder, by application


class NoSharedFolder(RuntimeError):
    """A cluster's session must name a folder that all machines share."""


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder that the session names in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of this process (``local[...]``) may do without: it
    gets a temporary folder of its own, removed when the process ends.  Any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _own[application], ignore_errors=True)
        base = _own[application]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For results that are costly and read more than once (embeddings above all): the
    work is done once, the lineage ends here, and a lost executor loses nothing.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if not any(str(f).endswith("/shelfmark.zip") for f in context.listFiles):
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="spark-")) / "shelfmark"
        context.addPyFile(shutil.make_archive(str(target), "zip", root, "shelfmark"))
    return spark
