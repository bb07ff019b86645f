"""Sources and sinks that outlive a failure: array snapshots in blocks, commits of ranges, merged runs, sessions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import embedding as E
from shelfmark.operators import index as I
from shelfmark.operators import search as S
from shelfmark.plans import jobs as J
from shelfmark.schema import INVENTORY
from shelfmark.sources import commits as K
from shelfmark.sources import merged as M
from shelfmark.sources import readers as R
from shelfmark.sources.json_arrays import read_json_arrays
from shelfmark.streaming import sessions as SE
from shelfmark.streaming import streams as ST


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd_objects(n):
    rng = random.Random(n)
    texts = ["", "}", "{", "]}", '"', "\\", '\\"}', "é日🙂", "\n\t", "a" * 700, "},{", '"}]', "\\\\}"]
    return [{"id": k, "t": rng.choice(texts) + rng.choice(texts), "m": {"x": [rng.choice(texts), {"y": []}], "}": None}} for k in range(n)]


def test_arrays_of_any_content_in_many_blocks(spark, tmp_path, small_blocks):
    pages = {"page-2.json": odd_objects(40), "page-10.json": odd_objects(30), "page-11.json": []}
    for name, posts in pages.items():
        (tmp_path / name).write_text(json.dumps(posts, ensure_ascii=name == "page-2.json", indent=None if name == "page-2.json" else 1) + "\n")
    got = [json.loads(r["text"]) for r in read_json_arrays(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == pages["page-2.json"] + pages["page-10.json"]      # page 2 before page 10, each in its order
    scan = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert scan.rdd.getNumPartitions() > 20


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}', "[1, 2]", '["a"]', "[[{}]]", "[", '[{"a": "x]', '{"a": 1}\n{"a": 2}', "nope"])
def test_other_files_are_no_arrays(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not a list of posts"):
        read_json_arrays(spark, str(tmp_path)).collect()


def test_posts_keep_their_order(spark, tmp_path, small_blocks):
    posts = [{"id": 9 - k, "title": {"rendered": "}{" * k}, "meta": {"b": 1, "a": "]"}} for k in range(9)]
    (tmp_path / "p.json").write_text(json.dumps(posts))
    rows = R.read_posts(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["id"] for r in rows] == [9 - k for k in range(9)] and json.loads(rows[3]["meta"]) == {"b": 1, "a": "]"}


def inventory_of(spark, n, changed=()):
    rows = [{**{f.name: None for f in INVENTORY.fields}, "row_index": k, "id": f"r{k}", "name": f"N{k}", "brand": "B", "image": "a.webp", "category": "Tea",
             "description": f"Words {k * (7 if k in changed else 1)} here" + (" outage" if k == 13 else ""), "effects": [], "flavors": []} for k in range(n)]
    return spark.createDataFrame([tuple(r[name] for name in INVENTORY.names) for r in rows], INVENTORY)


def counting(spark, fails=False, broken=False):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        if fails and any("outage" in t for t in texts):
            raise ConnectionError("the model is down")
        calls.add(len(texts))
        out = E.hashing_model(4)(texts)
        if broken:
            out[["outage" in t for t in texts]] = np.nan
        return out

    return model, calls


def test_a_broken_build_is_resumed_where_it_broke(spark, tmp_path):
    inventory, out = inventory_of(spark, 30), str(tmp_path / "field")
    model, _ = counting(spark, fails=True)
    with pytest.raises(Exception, match="the model is down"):
        J.build_field(spark, inventory, out, model, "m", 4, commit_rows=5)
    state = spark.read.json(f"{out}/state").first()
    assert (state["completed"], state["remaining"]) == (10, 20) and "the model is down" in state["last_error"]
    model, calls = counting(spark)
    vectors = J.build_field(spark, inventory, out, model, "m", 4, commit_rows=5)
    assert calls.value == 20 and vectors.count() == 30 and vectors.select("id").distinct().count() == 30
    model, calls = counting(spark)
    J.build_field(spark, inventory, out, model, "m", 4, commit_rows=7)
    assert calls.value == 0


def test_incomplete_vectors_are_made_again(spark, tmp_path):
    inventory, out = inventory_of(spark, 20), str(tmp_path / "field")
    model, _ = counting(spark, broken=True)
    with pytest.raises(J.FieldIncomplete, match="r13"):
        J.build_field(spark, inventory, out, model, "m", 4, commit_rows=6)
    model, calls = counting(spark)
    assert J.build_field(spark, inventory, out, model, "m", 4, commit_rows=6).count() == 20 and calls.value == 1


def test_unchanged_rows_are_carried_over(spark, tmp_path):
    out = str(tmp_path / "field")
    J.build_field(spark, inventory_of(spark, 20), out, counting(spark)[0], "m", 4, keep_unchanged=True, commit_rows=8)
    model, calls = counting(spark)
    changed = inventory_of(spark, 22, changed=(3, 4, 12))
    assert J.build_field(spark, changed, out, model, "m", 4, keep_unchanged=True, commit_rows=2).count() == 22
    assert calls.value == 5                                          # three changed, two new


def test_what_is_not_logged_is_not_read(spark, tmp_path):
    log = K.CommitLog(spark, str(tmp_path), "b")
    vectors = spark.createDataFrame([(0, "a", "h", [1.0]), (1, "b", "h", [float("nan")])], "row_index long, id string, text_hash string, embedding array<float>")
    vectors.write.parquet(log._path(0))                              # a commit that broke before its line
    assert log.commits() == [] and K.read_committed(spark, str(tmp_path)).count() == 0
    assert log.commit(vectors.limit(1), 0, 1, 1) == K.Commit(0, 0, 1, 1, True)
    assert not log.commit(vectors, 1, 3, 1).complete
    assert log.commit(vectors.limit(1), 3, 5, 1).number == 2
    assert log.ranges() == [(0, 1), (3, 5)]
    assert [r["row_index"] for r in log.outside(spark.range(6).withColumnRenamed("id", "row_index")).orderBy("row_index").collect()] == [1, 2, 5]


def test_commits_hold_about_as_many_rows_as_asked(spark):
    rng = random.Random(1)
    todo = sorted(rng.sample(range(500), 180))
    mask = spark.createDataFrame([(k, False) for k in todo], "row_index long, done boolean")
    plan = K.plan_commits(E.missing_batches(mask, 20, 100), 20, 100)
    assert sum(rows for _, _, rows in plan) == 180 and all(rows < 40 for _, _, rows in plan) and len(plan) >= 5
    assert all(a[1] <= b[0] for a, b in zip(plan, plan[1:]))
    assert all(rows == sum(first <= k < after for k in todo) for first, after, rows in plan)
    assert K.plan_commits(E.missing_batches(mask.limit(0), 20), 20) == []


def test_a_merged_table_stays_small(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "t")
    table = M.MergedTable(spark, path, F.col("k"), F.col("v"), F.col("seq"))
    everything = []
    for batch in range(22):
        rows = [(rng.choice("abcdefgh"), rng.choice(["1", "2", None, "3"]), 100 * batch + k) for k in range(6)]
        everything += rows
        df = spark.createDataFrame(rows, "k string, v string, seq long").coalesce(1)
        table.add(df, "w", batch)
        if batch % 7 == 0:
            table.add(df.withColumn("k", F.lit("replayed")), "w", batch)     # known by its number
        runs = table.manifest().runs
        assert len(runs) <= M.MOST_RUNS
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("run-")]
    kept = {r["name"] for r in table.manifest().runs} | set(table.manifest().retired)
    assert set(folders) == kept and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("manifest-")]) == 2
    whole = spark.createDataFrame(everything, "k string, v string, seq long")
    assert sorted(table.read().collect()) == sorted(ST.latest_per_key(whole, F.col("k"), F.col("v"), F.col("seq")).collect())
    assert {level: sum(r["level"] == level for r in runs) for level in range(M.LEVELS)}[M.LEVELS - 1] == 1


def put(spark, rows, schema, path):
    df = spark.createDataFrame(rows, schema).withColumn("asked_at", F.timestamp_seconds("asked_at"))
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_sessions_are_forgotten(spark, tmp_path):
    schema = "session string, seq long, asked_at long, q string"
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    batches = [
        [("a", 1, 1000, "x"), ("a", 3, 1010, "y"), ("a", 2, 1005, "z"), ("b", 7, 1000, "b"), (None, 1, 1000, "n"), ("c", None, 1000, "n")],
        [("a", 2, 1500, "late"), ("b", 8, 1500, "b2")],
        [("far", 1, 900_000, "f")],
        [("a", 1, 900_100, "anew")],
    ]
    known = []
    for batch in batches:
        stream = put(spark, batch, schema, source)
        ST.latest_request_stream(stream, lambda r: r.select("query_id", F.upper("q").alias("answer")), out, cp, ttl_ms=10_000_000, delay="1 hour").awaitTermination()
        known.append(sorted(r["k"] for r in SE.known_sessions(spark, cp).select(F.col("key.session").alias("k")).collect()))
    got = sorted((r["session"], r["seq"], r["answer"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, "ANEW"), ("a", 3, "Y"), ("b", 7, "B"), ("b", 8, "B2"), ("far", 1, "F")]
    assert known == [["a", "b"], ["a", "b"], ["far"], ["a", "far"]]     # the ttl of a and b is over


def test_search_answers_a_stream(spark, tmp_path):
    rows = inventory_of(spark, 12).withColumn("strain", F.lit(""))
    embed = E.embedder(E.hashing_model(4), 4)
    vectors = embed(rows, "description", "embedding")
    index = I.with_vectors(I.with_browse_ranks(I.search_index(rows)), vectors).cache()
    asked = [("s1", 1, "N3"), ("s1", 2, " "), ("s2", 5, "something calm for a long evening"), ("s3", 1, "N4"), ("s3", 2, "N4")]
    path = str(tmp_path / "in")
    requests = spark.createDataFrame(asked, "session string, seq long, q string").withColumns(
        {"category": F.lit("all"), "offset": F.lit(0), "limit": F.lit(3)})
    requests.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(requests.schema).parquet(path)
    ST.latest_request_stream(stream, lambda r: S.search(r, index, embed, 4), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "log"))
    modes = {(r["session"], r["seq"], r["query_mode"], r["n"]) for r in got.groupBy("session", "seq", "query_mode").agg(F.count("rank").alias("n")).collect()}
    assert modes == {("s1", 2, "browse", 3), ("s2", 5, "outcome", 3), ("s3", 2, "identity", 1)}
