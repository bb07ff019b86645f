import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import design as D
from shelfmark.schema import INVENTORY
from shelfmark.sources import readers as R
from shelfmark.sources import writers as W
from shelfmark.streaming import streams as ST


@pytest.fixture(scope="module")
def inventory(spark):
    rows = [{**{f.name: None for f in INVENTORY.fields}, "row_index": i, "id": f"r{i}", "name": f"N{i}", "brand": "B",
             "category": "C", "effects": ["x"], "flavors": []} for i in range(5)]
    return spark.createDataFrame([tuple(r[n] for n in INVENTORY.names) for r in rows], INVENTORY)


def test_inventory_as_lines_skips_blank_lines(spark, inventory, tmp_path):
    path = tmp_path / "inventory.jsonl"
    W.write_inventory_lines(inventory, str(path))
    (path / "part-x.json").write_text("\n" + json.dumps({"id": "extra", "row_index": 9}) + "\n\n")
    assert [r["id"] for r in R.read_inventory(spark, str(path)).orderBy("row_index").collect()] == [
        "r0", "r1", "r2", "r3", "r4", "extra"]
    assert R.read_inventory(spark, str(tmp_path / "absent")).isEmpty()
    assert R.read_vectors(spark, str(tmp_path / "absent")).isEmpty()


def test_public_catalogue_keeps_nulls(spark, inventory, tmp_path):
    W.write_catalogue(inventory, str(tmp_path / "c"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert len(lines) == 5 and len(lines[0]) == 17 and lines[0]["price"] is None and lines[0]["effects"] == ["x"]


def test_metadata_follows_the_vectors(spark, inventory):
    vectors = spark.createDataFrame([("r3",), ("r1",), ("r1",)], "id string")
    assert [r["id"] for r in W.metadata(inventory, vectors).collect()] == ["r1", "r3"]


def test_manifest_scan(spark, tmp_path):
    schema = spark.createDataFrame([], "count long, dim long").schema
    assert R.read_manifest(spark, str(tmp_path / "absent"), schema).isEmpty()
    (tmp_path / "broken.json").write_text("{nope")
    assert R.read_manifest(spark, str(tmp_path / "broken.json"), schema).isEmpty()
    W.write_manifest(spark.createDataFrame([(3, 72)], schema), str(tmp_path / "m"))
    served = W.served_manifest(R.read_manifest(spark, str(tmp_path / "m"), schema), "model").first()
    assert (served["count"], served["dimension"], served["ok"], served["embed_url"]) == (3, 72, True, "model")


def test_post_lines(spark, tmp_path):
    post = {"id": 1, "title": {"rendered": "T"}, "meta": {"b": {"y": 1, "x": 2}, "a": 1}}
    (tmp_path / "p.jsonl").write_text(json.dumps(post) + "\n")
    row = R.read_post_lines(spark, str(tmp_path / "p.jsonl")).first()
    assert json.loads(row["meta"]) == post["meta"] and row["meta"].index("b") < row["meta"].index("a")


def test_assets_are_listed_without_their_content(spark, tmp_path):
    (tmp_path / "a.webp").write_bytes(b"x" * 700)
    assets = R.read_assets(spark, str(tmp_path))
    assert [(r["name"], r["length"]) for r in assets.collect()] == [("a.webp", 700)]
    assert "content" not in assets._jdf.queryExecution().executedPlan().toString()


def test_item_label(spark, inventory):
    rows = inventory.limit(1).withColumn("subcategory", F.lit("")).unionByName(
        inventory.limit(1).withColumns({n: F.lit("") for n in ("brand", "category", "subcategory")}))
    assert sorted(r["label"] for r in D.item_label(rows).collect()) == ["B · C", "FIELD RECORD"]


def test_latest_request_of_each_session(spark, tmp_path):
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "log"), "session string, seq long, q string"

    def answer(requests):
        return requests.select("query_id", F.upper("q").alias("answer"))

    for batch in ([("a", 1, "x"), ("a", 2, "y"), ("b", 2, "z"), ("c", 2, "v")], [("a", 4, "w")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ST.latest_request_stream(stream, answer, out, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r["batch"], r["session"], r["answer"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, "a", "Y"), (0, "b", "Z"), (0, "c", "V"), (1, "a", "W")]


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from shelfmark.session import NoSharedFolder, work_dir

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId="app"))

    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(NoSharedFolder):
            work_dir(session(master, None), "x")
        assert work_dir(session(master, "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    assert work_dir(session("local[4]", None), "x") != work_dir(session("local[4]", None), "x")
