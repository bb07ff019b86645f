"""From raw posts to the published catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import vocabulary as V
from shelfmark.functions import fields as L
from shelfmark.functions import text as X
from shelfmark.functions.staging import stage
from shelfmark.operators.ordering import global_rank
from shelfmark.session import stored

_RESOLVED = ("brand", "category", "subcategory", "strain")
_PLAIN = ("description", "strain_type", "form", "jane_id", "sku", "unit", "thc", "cbd")
_TERMS = ("effects", "flavors")
_SECTIONS = {"s_phenotype": "PHENOTYPE", "s_lineage": "LINEAGE", "s_effects": "EFFECT PROFILE", "s_flavors": "FLAVOR PROFILE"}
# which lookup table each resolved column reads; a subcategory is named by the category table
LOOKUP_OF = {"brand": "brands", "category": "categories", "subcategory": "categories", "strain": "strains"}


# ---------------------------------------------------------------- JN-1 lookups

def lookup_names(posts: DataFrame) -> DataFrame:
    """``key, name`` of a lookup table; blank names dropped, the last post of an id wins.

    ``posts`` may carry ``seq`` (its order in the source); without it the greatest
    name wins, which is at least stable.
    """
    named = posts.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("key"), L.rendered(F.col("title")).alias("name"),
        (F.col("seq") if "seq" in posts.columns else F.lit(0)).alias("seq"),
    ).filter(F.col("name") != "")
    return named.groupBy("key").agg(F.max(F.struct("seq", "name"))["name"].alias("name"))


def lookup_items(value, texts=None):
    """``array<struct<key, text>>`` of a chosen value: whole numbers are keys, the rest is text.

    ``texts``: the value's item texts, when they are already at hand.
    """
    raw = F.when(L.is_list(value), L.json_items(value)).otherwise(F.array(value))
    texts = X.clean_each(L.item_texts(value) if texts is None else texts)

    def as_item(pair):
        number = F.floor(F.abs(L.number_of(pair["raw"]))) * F.signum(L.number_of(pair["raw"]))
        digits = F.regexp_extract(X.strip_space(L.scalar_text(pair["raw"])), r"^([+-]?[0-9]+(?:_[0-9]+)*)$", 1)
        listed = F.replace(digits, F.lit("_"), F.lit("")).try_cast("bigint")
        key = F.coalesce(number.cast("bigint"), listed)
        return F.struct(key.alias("key"), pair["text"].alias("text"))

    return F.transform(F.arrays_zip(raw.alias("raw"), texts.alias("text")), as_item)


def _joined(names):
    kept = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    return F.array_join(F.array_distinct(kept), ", ")


HOT = 1000  # of a join's keys so many, the most frequent, are met by broadcast


def resolve_lookups(rows: DataFrame, columns: dict[str, str], lookups: dict[str, DataFrame]) -> DataFrame:
    """Replace each ``array<struct<key, text>>`` column by its names joined with ', '.

    A key without a name is dropped.  The names of a row depend on its items alone, so each distinct
    set of items is resolved once, by an equi-join with the lookup tables, and joined back by content:
    rows need no key of their own.  Items without a key have no part in the join, and keys that many sets share are
    joined by broadcast as far as they are frequent; so are frequent sets when they go back to their rows.
    ``rows`` is read more than once and should be stored.
    """
    c = F.col
    given = F.struct(*[c(column) for column in columns])
    rows = rows.withColumn("__items", F.sha2(F.to_json(given), 256))
    tagged = F.concat(*[
        F.transform(F.coalesce(column, F.array().cast("array<struct<key: bigint, text: string>>")), lambda i, n: F.struct(
            F.lit(column).alias("column"), F.lit(table).alias("lookup"), n.alias("pos"), i["key"].alias("key"),
            i["text"].alias("text")))
        for column, table in columns.items()
    ])
    distinct = rows.groupBy("__items").agg(F.first(given).alias("given"), F.count("*").alias("__n")).select("__items", "__n", "given.*")
    items = distinct.select("__items", F.explode(tagged).alias("item")).select("__items", "item.*")
    names = None
    for table in sorted(set(columns.values())):
        mine = lookups[table].select(F.lit(table).alias("lookup"), "key", "name")
        names = mine if names is None else names.unionByName(mine)
    keyed = items.where("key is not null")
    named = _join_frequent(keyed, names, ["lookup", "key"], keyed.groupBy("lookup", "key").agg(F.count("*").alias("__n")), "left").select("__items", "column", "pos", c("name").alias("shown"))
    free = items.where("key is null").select("__items", "column", "pos", c("text").alias("shown"))
    per_set = named.unionByName(free).groupBy("__items").agg(*[
        _joined(F.transform(F.sort_array(F.collect_list(
            F.when(c("column") == column, F.struct("pos", "shown")))), lambda i: i["shown"])).alias(column)
        for column in columns
    ])
    filled = _join_frequent(rows.drop(*columns), per_set, ["__items"], distinct.select("__items", "__n"), "left").drop("__items")
    return filled.fillna("", list(columns))


def _join_frequent(rows: DataFrame, side: DataFrame, on: list[str], counts: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``side``, one row per key, by keys that are never null; ``counts``: ``__n`` rows of each key.

    Every key with more than a HOT-th of the rows is among the HOT most frequent: these meet their part of ``side`` by
    broadcast, and their rows are not shuffled.
    """
    hot = counts.orderBy(F.desc("__n"), *on).limit(HOT).select(*on)
    often = rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(side.join(F.broadcast(hot), on, "left_semi")), on, how)
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(side, on, how)
    return often.unionByName(rest)


# ---------------------------------------------------------------- FLD-10 normalise

def normalize_posts(
    posts: DataFrame,
    lookups: dict[str, DataFrame],
    base: str,
    id_prefix: str = "item-",
    source: str = "catalogue",
    fields: dict = V.FIELD_CHOICE,
    default_category: str = V.DEFAULT_CATEGORY,
) -> DataFrame:
    """The catalogue columns of every post, plus ``seq`` when the posts carry it."""
    c = F.col
    carried = [name for name in ("seq",) if name in posts.columns]
    bodies = ("title", "content", "excerpt")
    mapped = stage(posts.withColumn("fields", L.meta_fields(F.nullif(c("meta"), F.lit("null")))))
    chosen = stage(mapped.select(
        *carried, c("id").alias("wp_id"), "link",
        X.blank_to_null(X.first_filled(c("modified_gmt"), c("modified"))).alias("modified_gmt"),
        L.chosen_texts(c("fields"), fields.values()).alias("chosen"),
        F.array(*[X.first_filled(c(name)["rendered"], c(name)["raw"]) for name in bodies]).alias("bodies"),
        F.array(*L.media_sources(c("_embedded"))).alias("media"),
        F.array(*[c(name)[part] for name in bodies[1:] for part in ("rendered", "raw")]).alias("parts"),
    ))
    chosen = stage(chosen.withColumn("chosen", L.scalar_each(c("chosen"))))
    value = {name: c("chosen")[i] for i, name in enumerate(fields)}
    # each kind of text is worked on as one list, so its expression stands in the plan once
    texts = stage(chosen.select(
        *carried, "wp_id", "link", "modified_gmt", value["stock"].alias("c_stock"), value["price"].alias("c_price"),
        *[value[name].alias(f"c_{name}") for name in _RESOLVED],
        *[L.item_texts(value[name]).alias(f"i_{name}") for name in _RESOLVED],
        *[L.item_texts(value[name], r"[,;|/\n]").alias(f"i_{name}") for name in _TERMS],
        L.text_of(value["stock"]).alias("t_stock"), L.text_of(value["price"]).alias("t_price"),
        F.concat(F.transform(F.array(*[value[n] for n in _PLAIN]), L.text_of), "bodies").alias("texts"),
        F.concat(F.array(value["image"]), "media", "parts").alias("image_values"), F.array(value["product_url"]).alias("page_values"),
    ))
    # the plain texts after the media are looked at as they are
    texts = texts.withColumns({
        "image_sources": F.concat(L.url_sources(F.slice("image_values", 1, 4)), F.slice("image_values", 5, 4)),
        "page_sources": L.url_sources(c("page_values"))})
    decoded = stage(texts.select(
        *carried, "wp_id", "modified_gmt", X.clean_each(c("texts")).alias("cleaned"),
        (c("texts")[0] != "").alias("has_description"),
        *[lookup_items(c(f"c_{name}"), c(f"i_{name}")).alias(name) for name in _RESOLVED],
        *[X.split_terms_of(c(f"i_{name}")).alias(f"{name}_listed") for name in _TERMS],
        L.first_url_of(c("image_sources")).alias("image_url"),
        F.coalesce(L.first_url_of(c("page_sources")), c("link")).alias("product_url"),
        L.flag_of(c("c_stock"), c("t_stock")).alias("in_stock"),
        L.money_of(c("c_price"), c("t_price")).alias("price"),
    ))
    shaped = decoded.select("*", *[c("cleaned")[i].alias(n) for i, n in enumerate((*_PLAIN, *bodies))]).drop("cleaned")
    # a chosen description counts even when nothing is left of it after cleaning
    body = F.when(c("has_description"), c("description")).otherwise(X.first_filled(c("content"), c("excerpt")))
    described = stage(shaped.withColumn("description", F.get(X.clean_each(F.array(body)), F.lit(0))))
    sections = stage(described.select(
        "*",
        X.labelled_sections(c("description"), _SECTIONS.values()).alias("sections"),
        L.stable_id(id_prefix, c("jane_id"), c("sku"), c("wp_id").cast("string")).alias("__row"),
    ))
    sections = sections.select("*", *[c("sections")[i].alias(name) for i, name in enumerate(_SECTIONS)])
    sections = stage(sections.withColumns({f"{name}_told": X.split_terms(c(f"s_{name}")) for name in _TERMS}))
    kept = ("c_stock", "c_price", "sections", "bodies", "image_sources")
    sections = stored(sections.drop(*kept), "posts")  # read twice below, and dear to make
    resolved = resolve_lookups(sections, {n: LOOKUP_OF[n] for n in _RESOLVED}, lookups)

    def told_or_listed(name):
        told = c(f"{name}_told")
        return F.when(F.size(told) > 0, told).otherwise(c(f"{name}_listed")).alias(name)

    return resolved.select(
        *carried,
        c("__row").alias("id"), "wp_id",
        X.blank_to_null(c("jane_id")).alias("jane_product_id"), X.blank_to_null(c("sku")).alias("sku"),
        c("title").alias("name"), "brand", F.coalesce(X.blank_to_null(c("category")), F.lit(default_category)).alias("category"),
        "subcategory", "form", "strain", "strain_type", "description",
        told_or_listed("effects"), told_or_listed("flavors"), c("s_phenotype").alias("phenotype"),
        c("s_lineage").alias("lineage"), X.blank_to_null(c("thc")).alias("thc_text"), X.blank_to_null(c("cbd")).alias("cbd_text"),
        "price", "unit", "in_stock",
        L.absolute_url(c("image_url"), base).alias("image_url"),
        L.absolute_url(c("product_url"), base).alias("product_url"),
        "modified_gmt", F.lit(source).alias("source"), F.lit(base.split("://")[-1].strip("/")).alias("source_site"),
    )


def chosen_keys(posts: DataFrame, fields: dict = V.FIELD_CHOICE) -> DataFrame:
    """Which raw key each column of each post is read from; for checking a new source."""
    mapped = stage(posts.select("id", L.meta_fields(F.nullif(F.col("meta"), F.lit("null"))).alias("fields")))
    keyed = stage(mapped.select("id", L.choose_keys(F.col("fields"), fields.values()).alias("keys")))
    return keyed.select("id", *[F.col("keys")[i].alias(name) for i, name in enumerate(fields)])


# ---------------------------------------------------------------- AGG-1, FLT-1, FLT-2

def latest_per_key(rows: DataFrame, key, version, seq) -> DataFrame:
    """The newest version of each key; the first seen wins a tie.

    ``max_by`` combines on the map side, so a key with very many versions sends one
    row per partition.
    """
    order = F.struct(F.coalesce(version, F.lit("")).alias("version"), (-seq).alias("earlier"))
    best = rows.groupBy(key.alias("__key")).agg(F.max_by(F.struct("*"), order).alias("row"))
    return best.select("row.*")


def dedupe(rows: DataFrame) -> DataFrame:
    c = F.col
    key = F.coalesce(c("jane_product_id"), c("sku"), c("id"))
    return latest_per_key(rows, key, c("modified_gmt"), c("seq") if "seq" in rows.columns else c("wp_id"))


def drop_out_of_stock(rows: DataFrame, include_out_of_stock: bool = False) -> DataFrame:
    """Only an explicit false is dropped; unknown stock stays."""
    return rows if include_out_of_stock else rows.filter(F.col("in_stock").eqNullSafe(False) == F.lit(False))


def usable_assets(assets: DataFrame, suffix: str = ".webp") -> DataFrame:
    """Names of the stored files (``name, length``) of the right kind that are no stubs."""
    kept = F.endswith("name", F.lit(suffix)) & (F.col("length") >= V.MIN_ASSET_BYTES)
    return assets.filter(kept).select("name").distinct()


def split_by_asset(rows: DataFrame, assets: DataFrame, folder: str = "assets/inventory", suffix: str = ".webp"):
    """FLT-2, SNK-3: rows whose image file exists and is no stub, and the rest with a reason.

    ``assets``: ``name, length`` of the stored files.
    """
    digest = L.asset_digest(F.col("id"), F.col("image_url"))
    placed = rows.withColumn("__file", F.concat(digest, F.lit(suffix)))
    usable = usable_assets(assets, suffix).select(F.col("name").alias("__file"))
    found = placed.join(usable.withColumn("__found", F.lit(True)), "__file", "left")
    ready = found.filter("__found").withColumn("image", F.concat(F.lit(folder.rstrip("/") + "/"), "__file"))
    error = F.when(X.blank_to_null(F.col("image_url")).isNull(), F.lit("missing image URL")).otherwise(
        F.lit("no usable image file"))
    missing = found.filter(F.col("__found").isNull()).withColumn("image_error", error)
    return ready.drop("__file", "__found"), missing.drop("__file", "__found")


# ---------------------------------------------------------------- SRT-1, AGG-2, AGG-7

class TooFewRows(RuntimeError):
    """Nothing is published when fewer rows than the minimum survive."""


def require_minimum(rows: DataFrame, minimum: int = V.MIN_PUBLISH_ROWS) -> None:
    count = rows.limit(minimum).count()
    if count < minimum:
        raise TooFewRows(f"only {count} image-backed rows survived, {minimum} are required; nothing was published")


def publish_order(rows: DataFrame) -> DataFrame:
    """SRT-1: ``row_index`` is the position by category, brand, name and id."""
    c = F.col
    keyed = rows.select("*", *[F.coalesce(c(k), F.lit("")).alias(f"__{k}") for k in ("category", "brand", "name")])
    ranked = global_rank(keyed, [], ["__category", "__brand", "__name", "id"], "row_index")
    return ranked.withColumn("row_index", c("row_index") - 1).drop("__category", "__brand", "__name")


def run_counts(raw: DataFrame, deduped: DataFrame, ready: DataFrame, missing: DataFrame) -> DataFrame:
    """AGG-2: one row of counts."""
    parts = None
    for name, df in (("raw_products", raw), ("deduped_products", deduped),
                     ("searchable_products", ready), ("missing_image_products", missing)):
        one = df.select(F.lit(name).alias("measure"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(*[
        F.count_if(F.col("measure") == name).alias(name)
        for name in ("raw_products", "deduped_products", "searchable_products", "missing_image_products")
    ])
