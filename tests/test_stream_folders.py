"""Streams over tables that are folders of files, as large tables are."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark import cloudpickle

import __spark_entry__ as entry
from shelfmark.plans import queries as Q
from shelfmark.streaming.sessions import LatestRequest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [1, Q.STREAM_BYTES])  # a file a batch, all files in one
@pytest.mark.parametrize("name, source, key", [
    ("stream_latest_request", "conversations", "turn"), ("stream_embedding", "documents", "doc_id")])
def test_stream_over_a_folder(spark, tmp_path, monkeypatch, name, source, key, most):
    monkeypatch.setattr(Q, "STREAM_BYTES", most)
    rows = spark.read.parquet(f"{FOLDER}/{source}.parquet")
    for part in range(3):  # the turns of one conversation lie in several files
        rows.where(f"{key} % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{source}.parquet")
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {source} AS SELECT * FROM '{FOLDER}/{source}.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["events", "documents"])
def test_table_stream_reads_one_file_too(spark, tmp_path, name):
    stream = Q.table_stream(spark, FOLDER, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/o")
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o").count() == spark.read.parquet(f"{FOLDER}/{name}.parquet").count()


def test_processor_needs_no_package(tmp_path):
    path = tmp_path / "processor"
    path.write_bytes(cloudpickle.dumps(LatestRequest(5)))
    code = f"from pyspark import cloudpickle; print(cloudpickle.loads(open({str(path)!r}, 'rb').read()).ttl_ms)"
    environment = {"PATH": "/usr/bin", "PYTHONPATH": str(Path(sys.modules["pyspark"].__file__).parents[1])}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "5", done.stderr


@pytest.mark.parametrize("most", [1, Q.STREAM_BYTES])
def test_stream_embedding_on_odd_documents(spark, tmp_path, monkeypatch, most):
    """Nulls, rows that stand twice, texts of Unicode space alone."""
    monkeypatch.setattr(Q, "STREAM_BYTES", most)
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, "d"), (None, None), (2, None), (3, ""), (4, " \t\n\f\r"),
            (5, "\u00a0"), (6, "\u3000 \u2003"), (7, "\x0b"), (8, "\x1c\x85"), (9, "\u00a0x")]
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("stream_embedding", "embed_table"):
        got = entry.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(entry.oracle_sql()[name]).fetchall()))
