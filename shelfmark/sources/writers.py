"""Sinks: inventory, public catalogue, rejects, manifests, vectors, designs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import vocabulary as V


def write_inventory(rows: DataFrame, path: str) -> None:
    """SNK-1: sorted by ``row_index``; files hold consecutive ranges, so pages prune files."""
    ordered = rows.repartitionByRange("row_index").sortWithinPartitions("row_index")
    ordered.write.mode("overwrite").parquet(path)


def write_inventory_lines(rows: DataFrame, path: str) -> None:
    """SNK-1 as JSON lines."""
    rows.orderBy("row_index").write.mode("overwrite").json(path)


def public_catalogue(rows: DataFrame) -> DataFrame:
    return rows.select(*V.PUBLIC_COLUMNS)


def write_catalogue(rows: DataFrame, path: str) -> None:
    """SNK-2: the seventeen public columns, nulls kept as in the source."""
    ordered = rows.orderBy("row_index") if "row_index" in rows.columns else rows
    public_catalogue(ordered).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_rejects(rows: DataFrame, path: str) -> None:
    """SNK-3."""
    rows.write.mode("overwrite").json(path)


def write_manifest(one_row: DataFrame, path: str) -> None:
    """SNK-4: a one-row table."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def served_manifest(manifest: DataFrame, embed_model: str, design_schema: str = "effect-design-v1") -> DataFrame:
    """SNK-4: the manifest as a client sees it."""
    return manifest.withColumns({
        "ok": F.lit(True), "dimension": F.col("dim"), "embed_url": F.lit(embed_model),
        "fast_embed_url": F.lit(embed_model), "design_schema": F.lit(design_schema), "design_ready": F.lit(True),
    })


def append_vectors(vectors: DataFrame, path: str) -> None:
    """SNK-7: the commit protocol makes each append all or nothing."""
    vectors.select("id", "text_hash", "embedding").write.mode("append").parquet(path)


def metadata(inventory: DataFrame, vectors: DataFrame) -> DataFrame:
    """SNK-5: catalogue rows that have a vector, joined by key instead of copied by position."""
    return inventory.join(vectors.select("id").distinct(), "id", "left_semi").orderBy("row_index")


def write_designs(documents: DataFrame, path: str) -> None:
    """SNK-6: one JSON document per line."""
    documents.select("document").write.mode("overwrite").text(path)
