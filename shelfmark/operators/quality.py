"""Checks of a published field: one row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import vocabulary as V
from shelfmark.functions import text as X
from shelfmark.functions import vectors as VX
from shelfmark.operators.catalogue import usable_assets
from shelfmark.operators.fingerprint import fingerprint

SAMPLE = 20


class ChecksFailed(RuntimeError):
    """At least one check did not pass."""


def _sampled(bad: DataFrame, check: str, sample_key: str) -> DataFrame:
    """Count of bad rows with a few of their keys; the keys are cut before they are gathered."""
    few = bad.select(F.col(sample_key).cast("string").alias("k")).orderBy("k").limit(SAMPLE)
    sample = few.agg(F.coalesce(F.sort_array(F.collect_list("k")), F.array().cast("array<string>")))
    return bad.agg(F.count("*").alias("bad_rows")).select(
        F.lit(check).alias("check"), (F.col("bad_rows") == 0).alias("passed"), "bad_rows", sample.scalar().alias("sample")
    )


def _single(one_row: DataFrame, check: str, passed: Column) -> DataFrame:
    ok = F.coalesce(passed, F.lit(False))
    return one_row.select(
        F.lit(check).alias("check"), ok.alias("passed"), F.when(ok, 0).otherwise(1).cast("long").alias("bad_rows"),
        F.array().cast("array<string>").alias("sample"),
    )


def schema_version(manifest: DataFrame, expected: str) -> DataFrame:  # DQ-1
    return _single(manifest, "schema", F.col("schema_version") == expected)


def row_count(manifest: DataFrame, rows: DataFrame) -> DataFrame:  # DQ-2
    counted = manifest.select("count", rows.agg(F.count("*")).scalar().alias("n"))
    return _single(counted, "count", F.coalesce(F.col("count"), F.lit(0)) == F.col("n"))


def vector_shape(rows: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:  # DQ-3
    """Rows without exactly one vector of the right size, and vectors without a row."""
    sizes = vectors.groupBy("id").agg(
        F.count("*").alias("n"), F.max(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).alias("wrong"))
    keys = rows.select("id", F.lit(True).alias("has_row"))
    both = keys.join(sizes, "id", "full_outer")
    bad = F.col("has_row").isNull() | F.col("n").isNull() | (F.col("n") != 1) | F.col("wrong")
    return _sampled(both.filter(bad), "shape", "id")


def fingerprint_matches(manifest: DataFrame, rows: DataFrame, version: str) -> DataFrame:  # DQ-4
    current = fingerprint(rows, version).select("fingerprint")
    return _single(manifest.withColumn("now", current.scalar()), "fingerprint", F.col("source_fingerprint") == F.col("now"))


def assets_present(rows: DataFrame, assets: DataFrame) -> DataFrame:  # DQ-5, JN-3
    """Rows whose image names no usable file; ``assets`` (``name, length``) as ``read_assets`` gives them."""
    named = rows.withColumn("name", F.element_at(F.split(F.coalesce("image", F.lit("")), "/"), -1))
    return _sampled(named.join(usable_assets(assets), "name", "left_anti"), "images", "id")


def none_out_of_stock(rows: DataFrame) -> DataFrame:  # DQ-6
    return _sampled(rows.filter(F.col("in_stock") == F.lit(False)), "stock", "id")


def norm_statistics(vectors: DataFrame) -> DataFrame:  # AGG-8
    length = vectors.select(VX.is_finite(F.col("embedding")).alias("ok"), VX.norm(F.col("embedding")).alias("n"))
    return length.agg(
        F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("not_finite"),
        F.max(F.when(F.col("ok"), F.abs(F.col("n") - 1))).alias("max_error"),
    )


def unit_norms(vectors: DataFrame) -> DataFrame:  # DQ-7
    off = F.abs(VX.norm(F.col("embedding")) - 1) >= V.UNIT_TOLERANCE
    return _sampled(vectors.filter(~VX.is_finite(F.col("embedding")) | off), "normalized", "id")


def leaked_identity(texts: DataFrame) -> DataFrame:  # DQ-8
    """Rows whose record text holds their own long name or brand."""
    c = F.col

    def leaks(field: str) -> Column:
        value = F.lower(X.strip_space(F.coalesce(c(field), F.lit(""))))
        return (F.length(value) >= V.LEAK_MIN_CHARS) & F.contains(F.lower("record_text"), value)

    flagged = texts.withColumn("fields", F.array_compact(F.array(
        F.when(leaks("name"), F.lit("name")), F.when(leaks("brand"), F.lit("brand")))))
    return flagged.filter(F.size("fields") > 0)


def no_leaks(texts: DataFrame) -> DataFrame:
    return _sampled(leaked_identity(texts), "metadata_exclusion", "id")


def no_empty_text(texts: DataFrame) -> DataFrame:  # DQ-9
    blank = X.strip_space(F.coalesce(F.col("record_text"), F.lit(""))) == ""
    return _sampled(texts.filter(blank), "record_text", "id")


def no_missing_vectors(texts: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:  # DQ-10
    done = vectors.filter(VX.is_complete(F.col("embedding"), dim)).select("id")
    return _sampled(texts.join(done, "id", "left_anti"), "complete", "id")


def verify(
    manifest: DataFrame, rows: DataFrame, texts: DataFrame, vectors: DataFrame, assets: DataFrame, version: str, dim: int
) -> DataFrame:
    """All checks as one table.  ``texts`` holds ``id, name, brand, record_text``."""
    checks = [
        schema_version(manifest, version), row_count(manifest, rows), vector_shape(rows, vectors, dim),
        fingerprint_matches(manifest, rows, version), assets_present(rows, assets), none_out_of_stock(rows),
        unit_norms(vectors), no_leaks(texts), no_empty_text(texts), no_missing_vectors(texts, vectors, dim),
    ]
    report = checks[0]
    for check in checks[1:]:
        report = report.unionByName(check)
    return report


def require(report: DataFrame) -> None:
    """Raise when a check of the report (one row per check) failed."""
    failed = report.filter(~F.col("passed")).collect()
    if failed:
        raise ChecksFailed("; ".join(f"{r['check']}: {r['bad_rows']} bad, e.g. {r['sample'][:3]}" for r in failed))
