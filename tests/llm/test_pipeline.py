"""The pipeline over a small corpus whose right outcome is known, and its stages over awkward rows."""

import collections
import random

import pytest

import corpus_pipeline as P
from shelfmark.llm.encoding import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = {k: prose(25) for k in range(6)}
    docs, fate = {}, {}
    for k in range(160):
        docs[k], fate[k] = prose(rng.choice([40, 90, 400])), "kept"
    for k in range(160, 240):
        docs[k], fate[k] = " ".join(rng.choice(["$$$", "###", "&&&"]) + word() for _ in range(60)), "rejected"
    for k in range(240, 270):
        docs[k], fate[k] = docs[k - 240] + (" " + word() if k % 2 else ""), "duplicate"
    for k in range(270, 290):
        docs[k], fate[k] = prose(50) + " " + items[k % 6] + " " + prose(30), "leak"
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k, t, "en", "s", len(t)) for k, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(f != "rejected"), 0) for k, f in fate.items()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, fate


def test_each_stage_drops_what_it_should(spark, corpus):
    folder, _, fate = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = set(fate)
    for (name, stage), gone in zip(P.STAGES[:-1], ("rejected", "duplicate", "leak"), strict=True):
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == COLUMNS, name
        left -= {k for k, f in fate.items() if f == gone}
        assert {r.doc_id for r in docs.collect()} == left, name


def test_run_packs_every_id_of_what_is_left(spark, corpus):
    from tokenizers import Tokenizer

    folder, docs, fate = corpus
    rows = P.run(spark, folder).collect()
    model = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == {k for k, f in fate.items() if f == "kept"}
    for k, mine in pieces.items():
        assert [i for r in sorted(mine, key=lambda r: r.start) for i in r.ids] == [*model.encode(docs[k], add_special_tokens=False).ids, 2]


def test_awkward_rows(spark, corpus, odd_docs):
    folder, docs, _ = corpus
    rows = [(None, docs[0]), (1000, docs[1]), (1000, docs[1]), (1001, docs[1]), (1002, None), (1003, ""), (None, None)]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA).withColumnRenamed("source", "score")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, df, folder).columns == df.columns
        assert stage(spark, df.limit(0), folder).count() == 0
        assert stage(spark, odd_docs, folder).columns == odd_docs.columns
    kept = collections.Counter(r.doc_id for r in P.deduplication(spark, df, folder).collect())
    assert kept == {None: 2, 1000: 2, 1002: 1, 1003: 1}
    assert P.packing(spark, df.limit(0), folder).count() == 0


def test_names():
    assert [name for name, _ in P.STAGES] == ["quality", "deduplication", "decontamination", "packing"] and P.ORACLE_SQL is None


def test_own_columns_keep_their_values(spark, corpus):
    """Columns that bear names the stages use themselves come out as they went in."""
    folder, docs, fate = corpus
    kept = [k for k, f in fate.items() if f == "kept"][:12]
    names = ["doc_id", "text", "score", "__text", "_score", "kept"]
    rows = [(k, docs[k], 7.0 + k, f"own {k}", k, "x") for k in kept]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, __text string, _score long, kept string")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, folder)
        assert out.columns == names, name
        assert sorted(map(tuple, out.collect())) == sorted(rows), name
