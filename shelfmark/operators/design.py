"""Effect design: the catalogue rows and library entries nearest to a described target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import vocabulary as V
from shelfmark.functions import design_text as DT
from shelfmark.functions import fields as L
from shelfmark.functions import text as X
from shelfmark.functions import vectors as VX
from shelfmark.operators.ranking import best_rows
from shelfmark.schema import LIBRARY
from shelfmark.session import stored


def default_library(spark: SparkSession) -> DataFrame:
    """The sixteen built-in entries, in their order."""
    rows = spark.createDataFrame([row[:5] + (row[5], row[6]) for row in V.LIBRARY_ROWS], LIBRARY)
    place = F.array_position(F.array(*[F.lit(row[0]) for row in V.LIBRARY_ROWS]), F.col("name"))
    return rows.withColumn("row_index", (place - 1).cast("long"))


def with_library_text(library: DataFrame) -> DataFrame:
    return library.withColumn("library_text", DT.library_text(F.col("profile"), F.col("evidence"), F.col("guardrail")))


def with_target_text(requests: DataFrame) -> DataFrame:
    names = ("intent", "path", "thc", "duration", "route", "guardrails")
    trimmed = requests.withColumn("intent", X.strip_space("intent"))
    asked = trimmed.filter(F.col("intent") != "")
    return asked.withColumn("target_text", DT.target_text(*[F.col(n) for n in names]))


def nearest(targets: DataFrame, items: DataFrame, k: int, dim: int) -> DataFrame:
    """SRT-6: ``query_id, rank, row_index, score`` of the ``k`` items nearest each target."""
    queries = targets.select(
        F.col("request_id").alias("query_id"), F.lit(k).alias("need"),
        VX.unit_or_zero(F.col("vector")).alias("vector"))
    return best_rows(items, queries, dim)


def _as_list(ranked: DataFrame, details: DataFrame, fields: list[str], name: str) -> DataFrame:
    """One array per request; a request has at most ``k`` ranked rows, so the array is short."""
    entry = F.struct("rank", *fields, "score")
    listed = ranked.join(details, "row_index").groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias(name))
    return listed.withColumnRenamed("query_id", "request_id")


def design(
    requests: DataFrame, items: DataFrame, library: DataFrame, embed, dim: int,
    instrument: str = "the vector field", schema: str = "effect-design-v1",
) -> DataFrame:
    """VEC-6.  ``items``: a stored table of ``row_index, name, category, embedding``; ``library``: as ``default_library``.

    The result keeps the programme, the signature and both ranked lists; FLT-7 tells
    which lists a path shows.
    """
    c = F.col
    targets = stored(embed(with_target_text(requests), "target_text", "vector"), "targets")
    entries = stored(embed(with_library_text(library), "library_text", "embedding"), "library")
    near_items = nearest(targets, items, V.DESIGN_TOP_ITEMS, dim)
    near_library = nearest(targets, entries, V.DESIGN_TOP_LIBRARY, dim)
    item_list = _as_list(near_items, items.select("row_index", "name", "category"), ["name", "category"], "benchmarks")
    library_fields = ["name", "source", "class", "evidence", "guardrail"]
    library_list = _as_list(near_library, library.select("row_index", *library_fields), library_fields, "candidates")
    joined = targets.drop("vector").join(item_list, "request_id", "left").join(library_list, "request_id", "left")
    names = [F.transform(F.coalesce(c(n), F.array()), lambda e: e["name"]) for n in ("benchmarks", "candidates")]
    spec = [c(n) for n in ("path", "thc", "duration", "route", "guardrails")]
    return joined.select(
        "request_id", F.lit(schema).alias("schema"),
        F.struct("intent", "path", "thc", "duration", "route", "guardrails").alias("target"), "target_text",
        F.lit(instrument).alias("measured_by"),
        c("benchmarks").alias("existing_benchmarks"), c("candidates").alias("natural_candidates"),
        DT.programme(c("path"), *names, instrument).alias("development_program"),
        DT.signature(*spec).alias("signature"),
        (c("path") != "cultivar").alias("shows_candidates"), (c("path") != "botanical").alias("shows_benchmarks"),
        F.lit(V.SAFETY_BOUNDARY).alias("safety_boundary"),
    )


def export(designs: DataFrame) -> DataFrame:
    """SNK-6: one JSON document per request."""
    parts = [n for n in designs.columns if n not in ("request_id", "signature")]
    return designs.select("request_id", F.to_json(F.struct(*parts)).alias("document"))


def item_label(rows: DataFrame) -> DataFrame:
    """FLD-13 for ranked catalogue rows."""
    c = F.col
    return rows.withColumn("label", L.label_line(c("brand"), c("category"), c("subcategory"), fallback="FIELD RECORD"))
