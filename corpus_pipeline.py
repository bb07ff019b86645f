"""A corpus pipeline of four stages: quality, near duplicates, decontamination, packing.

Every stage but the last returns the columns of ``documents``.  Rows of equal id are one document
with several texts; rows of null id are documents of their own that resemble nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.contamination import without_contamination
from shelfmark.llm.encoding import tokenizer_path
from shelfmark.llm.names import fresh
from shelfmark.llm.near_duplicates import near_duplicates
from shelfmark.llm.packing import pack
from shelfmark.llm.quality import fit_quality, score_quality
from shelfmark.session import ship_package, stored

ORACLE_SQL = None  # a network, MinHash and a tokenizer are beyond SQL; tests hold each stage against brute force


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (a score of 0.5 or more)."""
    network = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return score_quality(docs, network, score=score).where(F.col(score) >= 0.5).select(docs.columns)


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates; texts without words stay."""
    found = near_duplicates(docs)
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept")
    return docs.join(stored(gone.select("doc_id"), "duplicates"), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every id of every document in sequences of 4096."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", quality), ("deduplication", deduplication), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again as the next one's input."""
    docs = ship_package(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
