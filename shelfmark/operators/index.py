"""The search index: one row per catalogue row, with everything a search needs precomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import vocabulary as V
from shelfmark.functions import text as X
from shelfmark.operators.ordering import global_rank

WHOLE = "*"  # scope of a request without a category limit; no normalised category holds it


def search_index(inventory: DataFrame, default_category: str = V.DEFAULT_CATEGORY) -> DataFrame:
    """Normalised identity values, category scope and descriptor text of each row."""
    c = F.col
    fields = [c(f) for f in ("category", "subcategory", "form", "strain_type", "phenotype", "lineage", "description")]
    return inventory.select(
        "row_index", "id",
        *[F.coalesce(c(f), F.lit("")).alias(f) for f in ("category", "brand", "name")],
        X.normalize(F.coalesce(X.blank_to_null(c("category")), F.lit(default_category))).alias("scope"),
        F.array(*[X.normalize(c(f)) for f in ("name", "brand", "strain")]).alias("identity"),
        X.descriptor_text(fields, c("effects"), c("flavors")).alias("descriptor"),
    )


def with_browse_ranks(index: DataFrame) -> DataFrame:
    """WIN-3, SRT-2: the position of each row in the whole catalogue and in its category."""
    ranked = global_rank(index, [], ["category", "brand", "name", "row_index"], "browse_rank")
    return global_rank(ranked, ["scope"], ["brand", "name", "row_index"], "category_rank")


def with_vectors(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """JN-2: rows and vectors meet by key, not by position; a row without a vector can still be browsed and named."""
    return index.join(vectors.select("id", "embedding"), "id", "left")


def scope_sizes(index: DataFrame) -> DataFrame:
    """AGG-3, AGG-6: rows per category scope and for the whole catalogue."""
    per_scope = index.groupBy("scope").agg(F.count("*").alias("total"))
    whole = per_scope.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return per_scope.unionByName(whole.select(F.lit(WHOLE).alias("scope"), "total"))


def category_list(rows: DataFrame, column: str = "category") -> DataFrame:
    """AGG-3: distinct categories in order, with their row counts."""
    filled = rows.filter(X.blank_to_null(F.col(column)).isNotNull())
    return filled.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("rows")).orderBy("category")


def identity_values(index: DataFrame) -> DataFrame:
    """AGG-5: the distinct non-blank identity values."""
    values = index.select(F.explode(F.array_distinct("identity")).alias("value"))
    return values.filter(F.col("value") != "").distinct()
