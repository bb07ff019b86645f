"""The end-to-end jobs: catalogue, field, verification."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schema as S
from shelfmark import vocabulary as V
from shelfmark.functions import vectors as VX
from shelfmark.operators import catalogue as C
from shelfmark.operators import embedding as E
from shelfmark.operators import quality as Q
from shelfmark.operators.fingerprint import fingerprint
from shelfmark.operators.redaction import with_record_text
from shelfmark.session import stored
from shelfmark.sources import readers as R
from shelfmark.sources import writers as W
from shelfmark.sources.commits import CommitLog, plan_commits, read_committed

SCHEMA_VERSION = "catalogue-v2"
IMAGE_POLICY = "Only rows with a stored image are searchable"


@dataclass
class CatalogueOptions:
    """What a site needs to be told; lookups are folders of posts, assets a folder of files."""

    base: str
    products: str
    assets: str
    lookups: dict[str, str] = field(default_factory=dict)
    id_prefix: str = "item-"
    source: str = "catalogue"
    include_out_of_stock: bool = False
    minimum: int = V.MIN_PUBLISH_ROWS
    refresh: bool = False


def build_catalogue(spark: SparkSession, options: CatalogueOptions, out: str) -> DataFrame:
    """Posts to ``out/inventory``, ``out/catalogue``, ``out/rejects`` and ``out/manifest``.

    SRC-7: a non-empty published inventory is reused unless ``refresh`` is set.
    """
    if not options.refresh and R.path_exists(spark, f"{out}/inventory"):
        published = R.read_inventory(spark, f"{out}/inventory")
        if not published.isEmpty():
            return published
    posts = R.read_posts(spark, options.products)
    lookups = {
        name: C.lookup_names(R.read_auxiliary(spark, options.lookups.get(name, f"{options.products}.no-{name}")))
        for name in ("brands", "categories", "strains")
    }
    rows = C.normalize_posts(posts, lookups, options.base, options.id_prefix, options.source)
    deduped = C.dedupe(rows)
    # the expensive part, read by four sinks
    deduped = stored(deduped, "deduped")
    stocked = C.drop_out_of_stock(deduped, options.include_out_of_stock)
    ready, missing = C.split_by_asset(stocked, R.read_assets(spark, options.assets))
    ready = stored(ready, "ready")  # counted, sampled and ranked
    C.require_minimum(ready, options.minimum)
    published = C.publish_order(ready)
    W.write_inventory(published.select(*S.INVENTORY.names), f"{out}/inventory")
    inventory = R.read_inventory(spark, f"{out}/inventory")
    W.write_catalogue(inventory, f"{out}/catalogue")
    W.write_rejects(missing, f"{out}/rejects")
    manifest = C.run_counts(posts.select("id"), deduped, inventory, missing).withColumns({
        "source": F.lit(options.base), "scraped_at": F.current_timestamp(),
        "in_stock_only": F.lit(not options.include_out_of_stock), "image_policy": F.lit(IMAGE_POLICY),
    })
    W.write_manifest(manifest, f"{out}/manifest")
    return inventory


def field_config(inventory: DataFrame, model_name: str, dim: int, use_freq: bool = True, version: str = SCHEMA_VERSION) -> DataFrame:
    """One row: everything that must be unchanged for stored vectors to be reused."""
    content = [n for n in inventory.columns]
    return fingerprint(inventory, version, content).select(
        F.lit(version).alias("schema_version"), F.col("fingerprint").alias("source_fingerprint"),
        F.col("rows").alias("count"), F.lit(dim).cast("long").alias("dim"), F.lit(model_name).alias("embed_url"),
        F.lit(use_freq).alias("use_freq"),
    )


class FieldIncomplete(RuntimeError):
    """Rows are left without a complete vector."""


COMMIT_ROWS = 1 << 20  # rows embedded between two entries of the log


def build_field(
    spark: SparkSession, inventory: DataFrame, out: str, model: E.TextsToVectors, model_name: str, dim: int,
    use_freq: bool = True, keep_unchanged: bool = False, batch: int = 64, commit_rows: int = COMMIT_ROWS,
) -> DataFrame:
    """VEC-9: vectors of every row under ``out/vectors``, with ``out/state`` and ``out/manifest``.

    Rows are embedded in commits of about ``commit_rows`` rows, each durable by itself (SNK-7), so a build that
    broke is resumed at the first range that the log does not have.  A finished field of the same configuration
    is reused; any other is started anew in its own folder (nothing is deleted).  With ``keep_unchanged``
    vectors of the same model and text are carried over even though the inventory changed, so only new and
    changed rows are embedded.  ``out/state`` tells how far the last build came, and its error.
    """
    if not inventory.filter(_blank("image")).isEmpty():
        raise ValueError("the inventory holds rows without a stored image")
    config = field_config(inventory, model_name, dim, use_freq)
    settings = config.first()  # one row
    wanted = spark.createDataFrame([settings], config.schema)
    kept = ("schema_version", "dim", "embed_url", "use_freq") if keep_unchanged else config.columns
    tag = wanted.select(F.sha2(F.to_json(F.struct(*kept)), 256).alias("t")).first()["t"][:16]
    vectors_path = f"{out}/vectors/config={tag}"
    log = CommitLog(spark, vectors_path, settings["source_fingerprint"][:16])

    texts_path = f"{out}/texts/build={log.build}"
    if not R.path_exists(spark, f"{texts_path}/_SUCCESS"):  # made once for each inventory, whatever breaks later
        texts = E.with_text_hash(with_record_text(inventory)).select("row_index", "id", "record_text", "text_hash")
        texts.write.mode("overwrite").parquet(texts_path)
    texts = spark.read.parquet(texts_path)
    if not E.empty_texts(texts).isEmpty():
        raise ValueError("one or more rows produced an empty text")

    def finish() -> DataFrame:
        vectors = read_committed(spark, vectors_path).filter(VX.is_complete(F.col("embedding"), dim))
        return vectors.join(texts.select("id", "text_hash"), ["id", "text_hash"], "left_semi")

    open_rows = log.outside(texts).select("row_index", "id", "text_hash")
    todo = E.missing_rows(open_rows, read_committed(spark, vectors_path), dim).select("row_index", F.lit(False).alias("done"))
    todo = stored(todo, "todo")
    plan = plan_commits(E.missing_batches(todo, commit_rows), commit_rows)
    if not plan and E.config_matches(R.read_manifest(spark, f"{out}/manifest", config.schema), wanted):
        return finish()

    def save_state(left: int, error: str | None = None) -> None:
        W.write_manifest(wanted.withColumns({
            "completed": F.lit(settings["count"] - left), "remaining": F.lit(left), "last_error": F.lit(error).cast("string"),
            "updated_at": F.current_timestamp()}), f"{out}/state")

    left = sum(rows for _, _, rows in plan)
    try:
        for first, after, rows in plan:
            within = F.col("row_index").between(first, after - 1)
            part = texts.where(within)
            if rows < after - first:  # some rows of the range have a vector
                part = part.join(todo.where(within).select("row_index"), "row_index", "left_semi")
            part = part.repartition(max(1, min(rows // (4 * batch), 4 * spark.sparkContext.defaultParallelism)))
            log.commit(E.embed_column(part, "record_text", "embedding", model, dim, batch), first, after, dim)
            left -= rows
    except Exception as error:
        save_state(left, f"{type(error).__name__}: {str(error)[:500]}")
        raise
    vectors = read_committed(spark, vectors_path)
    counts = E.progress(texts, vectors, dim).first()
    save_state(counts["remaining"])
    if counts["remaining"]:
        some = E.missing_rows(texts, vectors, dim).select("id").limit(Q.SAMPLE).collect()
        raise FieldIncomplete(f"rows without a complete vector, e.g. {[r['id'] for r in some]}")
    W.write_manifest(wanted.withColumn("built_at", F.current_timestamp()), f"{out}/manifest")
    return finish()


def _blank(column: str):
    return F.coalesce(F.col(column), F.lit("")) == ""


def verify_field(
    spark: SparkSession, inventory: DataFrame, vectors: DataFrame, manifest_path: str, assets: DataFrame, dim: int,
    version: str = SCHEMA_VERSION,
) -> DataFrame:
    """All checks of a built field; raises when one fails."""
    config_schema = field_config(inventory, "", dim).schema
    manifest = R.read_manifest(spark, manifest_path, config_schema)
    texts = with_record_text(inventory).select("id", "name", "brand", "record_text")
    report = Q.verify(manifest, inventory, texts, vectors, assets, version, dim)
    Q.require(report)
    return report
