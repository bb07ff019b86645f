"""Small files and folders of any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if it is absent."""
    store, at = _at(spark, folder)
    return [status.getPath().getName() for status in store.listStatus(at)] if store.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all it holds."""
    store, at = _at(spark, path)
    store.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole, by a rename."""
    store, at = _at(spark, path)
    folder, name = path.rsplit("/", 1)
    _, part = _at(spark, f"{folder}/_{name}.part")
    out = store.create(part, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    if not store.rename(part, at):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    store, at = _at(spark, path)
    stream = store.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
