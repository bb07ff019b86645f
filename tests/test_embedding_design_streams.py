import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark import vocabulary as V
from shelfmark.functions import vectors as VX
from shelfmark.operators import design as D
from shelfmark.operators import embedding as E
from shelfmark.schema import DESIGN_REQUEST
from shelfmark.sources import readers as R
from shelfmark.streaming import streams as ST


def test_unit(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = df.select(VX.unit(F.col("v")).alias("u"), VX.unit_or_zero(F.col("v")).alias("z")).collect()
    assert np.allclose(got[0]["u"], [0.6, 0.8]) and got[1]["u"] == [0.0, 0.0] and got[1]["z"] == [0.0, 0.0]


@pytest.mark.parametrize("payload, expected", [
    ('{"vectors": [[3, 4], [1, 0]]}', [[0.6, 0.8], [1.0, 0.0]]),
    ('{"embeddings": [{"embedding": [3, 4]}, {"vector": [0, 1]}]}', [[0.6, 0.8], [0.0, 1.0]]),
    ('{"data": {"vectors": [[1, 0]]}}', [[1.0, 0.0]]),
    ('{"vectors": [], "embedding": [0, 5]}', [[0.0, 1.0]]),
    ('{"vector": [[0, 5], [5, 0]]}', [[0.0, 1.0], [1.0, 0.0]]),
    ("{}", ["no vectors"]), ("broken", ["no vectors"]), ('{"vectors": [[1, 2, 3]]}', ["wrong size"]),
])
def test_response_vectors(spark, payload, expected):
    df = spark.createDataFrame([(1, payload)], "response_id long, payload string")
    got = [r["error"] or list(r["vector"]) for r in E.response_vectors(df, 2).orderBy("position").collect()]
    assert len(got) == len(expected)
    for mine, wanted in zip(got, expected):
        assert mine == wanted if isinstance(wanted, str) else np.allclose(mine, wanted)


def test_read_flat_vectors(spark, tmp_path):
    values = np.arange(60, dtype="<f4").reshape(20, 3)
    values.tofile(tmp_path / "v.f32")
    got = R.read_flat_vectors(spark, str(tmp_path / "v.f32"), 3).orderBy("row_index").collect()
    assert [r["row_index"] for r in got] == list(range(20)) and np.array_equal([r["embedding"] for r in got], values)


def test_missing_batches(spark):
    done = {0, 1, 5, 6, 12}
    mask = spark.createDataFrame([(i, i in done) for i in range(20)], "row_index long, done boolean")
    got = sorted((r["start"], r["end"]) for r in E.missing_batches(mask, 3, 10).collect())
    assert got == [(2, 5), (7, 10), (10, 12), (13, 16), (16, 19), (19, 20)]     # cut at the shard border 10


def test_embed_column_is_independent_of_batches_and_checks_shape(spark):
    df = spark.createDataFrame([(i, f"word{i} tea") for i in range(50)], "id long, t string")
    a = E.embed_column(df, "t", "v", E.hashing_model(8), 8, 7).orderBy("id").collect()
    b = E.embed_column(df.repartition(3), "t", "v", E.hashing_model(8), 8, 64).orderBy("id").collect()
    assert a == b and all(abs(np.linalg.norm(r["v"]) - 1) < 1e-6 for r in a)
    with pytest.raises(Exception, match="expected"):
        E.embed_column(df, "t", "v", lambda texts: np.zeros((1, 3)), 8).collect()


def test_missing_rows_after_a_change(spark):
    texts = E.with_text_hash(spark.createDataFrame([("a", "x"), ("b", "new")], "id string, record_text string"))
    old = E.with_text_hash(spark.createDataFrame([("a", "x", [1.0]), ("b", "old", [1.0])], "id string, record_text string, embedding array<float>"))
    assert [r["id"] for r in E.missing_rows(texts, old, 1).collect()] == ["b"]


REQUESTS = [(1, " calm evening ", "both", "low", "short", "tea", ["fog"]), (2, "focus", "cultivar", "any", "long", "vape", []),
            (3, "rest", "botanical", "none", "long", "tea", []), (4, " ", "both", "", "", "", [])]


def test_design(spark):
    embed = E.embedder(E.hashing_model(16), 16)
    items = spark.createDataFrame([(i, f"item {i}", "Tea") for i in range(12)], "row_index long, name string, category string")
    items = embed(items.withColumn("t", F.concat("name", F.lit(" tea for a calm evening"))), "t", "embedding").drop("t")
    requests = spark.createDataFrame(REQUESTS, DESIGN_REQUEST)
    out = D.design(requests, items, D.default_library(spark), embed, 16, "the model").orderBy("request_id")
    got = out.collect()
    assert [r["request_id"] for r in got] == [1, 2, 3]                 # a blank intent is no request
    first = got[0]
    assert first["target_text"].startswith("Desired human state: calm evening. Find both") and "avoid fog." in first["target_text"]
    assert [len(first[n]) for n in ("existing_benchmarks", "natural_candidates")] == [8, 7]
    scores = [e["score"] for e in first["natural_candidates"]]
    assert scores == sorted(scores, reverse=True)
    names = " + ".join(e["name"] for e in first["existing_benchmarks"][:2])
    assert names in first["development_program"][0] and "the model" in first["development_program"][4]
    assert got[1]["development_program"][1] == V.STEP_2_CULTIVAR and not got[1]["shows_candidates"]
    assert got[2]["development_program"][0] == V.STEP_1_BOTANICAL and not got[2]["shows_benchmarks"]
    assert first["signature"][0]["value"] == "CULTIVAR + BOTANICAL"
    document = json.loads(D.export(out).first()["document"])
    assert document["target"]["guardrails"] == ["fog"] and "signature" not in document


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_upsert_stream_equals_batch_over_several_runs(spark, tmp_path):
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "log"), "k string, v string, seq long"
    how = (F.col("k"), F.col("v"), F.col("seq"))
    batches = [[("a", "1", 1), ("b", "5", 2)], [("a", "3", 3), ("b", "5", 4)], [("a", "2", 5), ("c", None, 6)]]
    for batch in batches:
        write(spark, batch, schema, source)
        stream = spark.readStream.schema(schema).parquet(source)
        ST.upsert_stream(stream, *how, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(ST.read_upserts(spark, out, *how).collect()) == sorted(
        ST.latest_per_key(spark.read.parquet(source), *how).collect())
    assert sorted(r["seq"] for r in ST.read_upserts(spark, out, *how).collect()) == [2, 3, 6]


def test_embedding_stream_embeds_each_text_once(spark, tmp_path):
    source, vectors, schema = str(tmp_path / "in"), str(tmp_path / "v"), "id string, record_text string"
    for batch in ([("a", "x"), ("b", "y")], [("a", "x"), ("b", "changed"), ("c", "z")]):
        write(spark, batch, schema, source)
        stream = E.with_text_hash(spark.readStream.schema(schema).parquet(source))
        ST.embedding_stream(stream, vectors, E.hashing_model(4), 4, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(vectors).groupBy("id").count().orderBy("id").collect() == [("a", 1), ("b", 2), ("c", 1)]
