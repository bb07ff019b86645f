"""Batch search: a table of requests in, a long table of result pages out.

``search`` routes each request to browsing, identity lookup or hybrid ranking.
``semantic_search`` is the second service: pure vector order, its own page limits
and category rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import vocabulary as V
from shelfmark.functions import text as X
from shelfmark.functions import vectors as VX
from shelfmark.operators.index import WHOLE, identity_values, scope_sizes
from shelfmark.operators.ordering import global_rank, page_slots, top_n
from shelfmark.operators.ranking import best_rows
from shelfmark.session import stored

RESULT = ["query_id", "rank", "row_index", "id", "score", "query_mode", "total", "query_text"]
Embedder = Callable[[DataFrame, str, str], DataFrame]  # (table, text column, vector column) -> table


# ---------------------------------------------------------------- requests

def clamp(offset: Column, limit: Column, default: int, most: int) -> list[Column]:
    """SRT-4: a missing or zero limit takes the default."""
    wanted = F.coalesce(F.nullif(limit, F.lit(0)), F.lit(default))
    return [
        F.greatest(F.lit(0), F.coalesce(offset, F.lit(0))).cast("int").alias("offset"),
        F.least(F.lit(most), F.greatest(F.lit(1), wanted)).cast("int").alias("limit"),
    ]


def named(requests: DataFrame, *names: str) -> list[Column]:
    """SRT-4: the columns of a request that may stand for one of its fields, those that are there."""
    return [F.col(name) for name in names if name in requests.columns]


def prepare_requests(requests: DataFrame) -> DataFrame:
    """A category may also be told as ``type``."""
    c = F.col
    trimmed = X.strip_space(F.coalesce(c("q"), F.lit("")))
    category = X.first_filled(*named(requests, "category", "type"), F.lit("all"))
    shaped = requests.select("query_id", trimmed.alias("q"), category.alias("category"),
                             *clamp(c("offset"), c("limit"), 24, 100))
    return shaped.select(
        "*",
        X.normalize(c("q")).alias("phrase"),
        X.normalize(c("category")).alias("category_norm"),
        (c("offset") + c("limit")).alias("need"),
    )


def route(requests: DataFrame, index: DataFrame) -> DataFrame:
    """SCH-1: adds ``query_mode`` and the ``scope`` the request ranges over.

    The request phrases (small) are matched to the catalogue's identity values
    first, so the catalogue side is only filtered, not shuffled whole.
    """
    c = F.col
    phrases = requests.filter(c("phrase") != "").select(c("phrase").alias("value")).distinct()
    values = index.select(F.explode(F.array_distinct("identity")).alias("value"))
    known = values.join(phrases, "value", "left_semi").distinct().select(
        c("value").alias("phrase"), F.lit(True).alias("known")
    )
    scopes = index.select(c("scope").alias("category_norm")).distinct().withColumn("has_scope", F.lit(True))
    intent = F.array(*[F.lit(w) for w in V.INTENT_WORDS])
    short = (
        (F.size(X.words(c("phrase"))) <= V.IDENTITY_MAX_WORDS)
        & ~F.arrays_overlap(X.terms_of_normal(c("phrase")), intent)
        & (F.length("phrase") >= V.MIN_TERM_CHARS)
    )
    mode = (
        F.when(c("q") == "", F.lit("browse"))
        .when(F.coalesce(c("known"), F.lit(False)) | short, F.lit("identity"))
        .otherwise(F.lit("outcome"))
    )
    # browsing an unknown category shows everything; searching in one finds nothing
    browse_scope = F.when(c("has_scope"), c("category_norm")).otherwise(F.lit(WHOLE))
    search_scope = F.when(c("category") == "all", F.lit(WHOLE)).otherwise(c("category_norm"))
    routed = requests.join(known, "phrase", "left").join(scopes, "category_norm", "left")
    return routed.withColumn("query_mode", mode).withColumn(
        "scope", F.when(c("query_mode") == "browse", browse_scope).otherwise(search_scope)
    ).drop("known", "has_scope")


# ---------------------------------------------------------------- branches

def browse_pages(requests: DataFrame, index: DataFrame) -> DataFrame:
    """SRT-2: pages are fetched by stored rank, so a deep offset costs no sort."""
    slots = page_slots(requests.select("query_id", "scope", "offset", "limit"))
    places = index.select(
        "row_index", "id",
        F.explode(F.array(
            F.struct(F.lit(WHOLE).alias("scope"), F.col("browse_rank").alias("rank")),
            F.struct(F.col("scope"), F.col("category_rank").alias("rank")),
        )).alias("place"),
    ).select("row_index", "id", "place.scope", "place.rank")
    return slots.join(places, ["scope", "rank"]).select(
        "query_id", "scope", "rank", "row_index", "id", F.lit(None).cast("double").alias("score")
    )


def _grams(text: Column, size: int) -> Column:
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.coalesce(F.array_distinct(cut), F.array().cast("array<string>"))


def phrase_matches(phrases: DataFrame, values: DataFrame) -> DataFrame:
    """``phrase, value, weight`` for every value that holds the phrase.

    The phrases and the distinct values meet on the phrase's rarest n-gram (three
    characters, fewer for shorter phrases), then the match itself is checked.
    """
    c = F.col
    sizes = range(1, V.MIN_TERM_CHARS + 1)
    own_size = F.least(F.length("phrase"), F.lit(V.MIN_TERM_CHARS))
    phrase_grams = phrases.select(
        "phrase", F.explode(F.concat(*[F.when(own_size == n, _grams(c("phrase"), n)).otherwise(
            F.array().cast("array<string>")) for n in sizes])).alias("gram"))
    value_grams = values.select(
        "value", F.explode(F.concat(*[_grams(c("value"), n) for n in sizes])).alias("gram")
    ).join(phrase_grams.select("gram").distinct(), "gram", "left_semi")
    frequency = value_grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = phrase_grams.join(frequency, "gram", "left").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("pick")
    ).select("phrase", "pick.gram")
    weight = (
        F.when(c("value") == c("phrase"), V.WEIGHT_EXACT)
        .when(F.startswith("value", "phrase"), V.WEIGHT_PREFIX)
        .otherwise(V.WEIGHT_INSIDE)
    )
    return value_grams.join(rarest, "gram").filter(F.contains("value", "phrase")).select(
        "phrase", "value", weight.alias("weight")
    )


def identity_matches(requests: DataFrame, index: DataFrame) -> DataFrame:
    """SCH-2 without paging: every matching row of each request with its best weight."""
    phrases = requests.select("phrase").filter(F.col("phrase") != "").distinct()
    hits = phrase_matches(phrases, identity_values(index))
    named = index.select("row_index", "id", "scope", "brand", "name",
                         F.explode(F.array_distinct("identity")).alias("value"))
    rows = named.join(hits, "value").groupBy("phrase", "row_index").agg(
        F.max("weight").alias("weight"), *[F.first(f).alias(f) for f in ("id", "scope", "brand", "name")]
    )
    wanted = requests.select("query_id", "phrase", F.col("scope").alias("wanted_scope"))
    return wanted.join(rows, "phrase").filter(
        (F.col("wanted_scope") == WHOLE) | (F.col("wanted_scope") == F.col("scope"))
    )


_BEST = ("brand", "name", "row_index")  # of rows of one weight


def _posting_lists(index: DataFrame, hits: DataFrame, need: int) -> DataFrame:
    """The first ``need`` rows of each matched value, in the whole catalogue and in each scope, as ``value, place, rank, ...``.

    A literal bound cuts every partition before the shuffle, so a value with very many rows sends few of them.
    """
    rows = index.select("row_index", "id", "scope", "brand", "name", F.explode(F.array_distinct("identity")).alias("value"))
    rows = rows.join(hits.select("value").distinct(), "value", "left_semi")
    order = [F.asc(n) for n in _BEST]
    whole = top_n(rows.withColumn("place", F.lit(WHOLE)), ["value"], order, need)
    scoped = top_n(rows.withColumn("place", F.col("scope")), ["value", "place"], order, need)
    return whole.unionByName(scoped).drop("scope")


def identity_pages(requests: DataFrame, hits: DataFrame, index: DataFrame) -> DataFrame:
    """SCH-2: the page of each request by merging the posting lists of the values that hold its phrase.

    ``hits``: ``phrase_matches``, stored.  A row of the first ``need`` stands among the first ``need`` of a list, and the list's first
    row stands before it; a row has three values at most.  So of a request's values, in order of weight and of their
    first rows, three times ``need`` are looked at, and ``need`` rows of each: never all rows that hold a phrase.
    """
    c = F.col
    need = int(requests.agg(F.max("need")).first()[0] or 1)
    lists = stored(_posting_lists(index, hits, need), "postings")
    asked = requests.filter(c("phrase") != "").groupBy("phrase", c("scope").alias("place")).agg(F.max("need").alias("need"))
    heads = lists.filter("rank = 1").select("value", "place", *_BEST)
    order = [F.desc("weight"), *[F.asc(n) for n in _BEST]]
    values = top_n(asked.join(hits, "phrase").join(heads, ["value", "place"]), ["phrase", "place"], order, 3 * need, "turn")
    values = values.filter(c("turn") <= 3 * c("need")).select("phrase", "place", "need", "value", "weight")
    rows = values.join(lists, ["value", "place"]).filter(c("rank") <= c("need")).groupBy("phrase", "place", "row_index").agg(
        F.max("weight").alias("weight"), *[F.first(n).alias(n) for n in ("id", "brand", "name")])
    ranked = top_n(rows, ["phrase", "place"], order, need).withColumnRenamed("place", "scope")
    pages = ranked.join(requests.select("query_id", "phrase", "scope", "offset", "need"), ["phrase", "scope"])
    return pages.filter((c("rank") > c("offset")) & (c("rank") <= c("need"))).drop("offset", "need").withColumn(
        "score", F.lit(None).cast("double"))


def identity_totals(requests: DataFrame, hits: DataFrame, index: DataFrame) -> DataFrame:
    """AGG-6: ``query_id, found``, the rows that hold each request's phrase, from counts of values.

    A row counts once although it may hold the phrase in several values: rows of single values are added, those of pairs of
    values that both hold it taken away, and those of triples added again.
    """
    c = F.col
    values = F.filter(F.array_sort(F.array_distinct("identity")), lambda v: v != "")
    phrases = hits.groupBy("value").agg(F.collect_set("phrase").alias("phrases"))  # parts of one value
    rows = index.select("scope", values.alias("v")).groupBy("scope", "v").agg(F.count("*").alias("n"))
    rows = rows.filter(F.size("v") > 0)

    def some(k: int) -> DataFrame:
        if k == 1:
            sets = F.transform("v", lambda x: F.array(x))
        elif k == 2:
            sets = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, 3), lambda y: F.array(x, y))))
        else:
            sets = F.when(F.size("v") == 3, F.array(c("v"))).otherwise(F.array().cast("array<array<string>>"))
        counted = rows.select("scope", "n", F.explode(sets).alias("s")).groupBy("scope", "s").agg(F.sum("n").alias("n"))
        for i in range(k):
            one = phrases.select(c("value").alias(f"v{i}"), c("phrases").alias(f"p{i}"))
            counted = counted.withColumn(f"v{i}", c("s")[i]).join(one, f"v{i}")
        both = c("p0")
        for i in range(1, k):
            both = F.array_intersect(both, f"p{i}")
        return counted.select("scope", (c("n") * (1 if k % 2 else -1)).alias("n"), F.explode(both).alias("phrase"))

    per_scope = some(1).unionByName(some(2)).unionByName(some(3)).groupBy("phrase", "scope").agg(F.sum("n").alias("found"))
    per_scope = stored(per_scope, "found")
    whole = per_scope.groupBy("phrase").agg(F.sum("found").alias("found")).withColumn("scope", F.lit(WHOLE))
    return requests.select("query_id", "phrase", "scope").join(per_scope.unionByName(whole), ["phrase", "scope"]).select("query_id", "found")


def _cut(ranked: DataFrame, requests: DataFrame) -> DataFrame:
    pages = requests.select("query_id", "offset", "need")
    return ranked.join(pages, "query_id").filter(
        (F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("need"))
    ).drop("offset", "need")


def hybrid_queries(requests: DataFrame, embed: Embedder) -> DataFrame:
    """TXT-11, VEC-1: the vector and the bonus terms of each request's canonical text."""
    texts = requests.select("query_id", "scope", "need", X.canonical_query(F.col("q")).alias("query_text"))
    return embed(texts, "query_text", "vector").select(
        "query_id", "need",
        F.when(F.col("scope") != WHOLE, F.col("scope")).alias("scope"),
        VX.unit(F.col("vector")).alias("vector"),
        F.array_distinct(X.meaningful_terms(F.col("query_text"))).alias("terms"),
    )


def hybrid_pages(requests: DataFrame, index: DataFrame, embed: Embedder, dim: int) -> DataFrame:
    """VEC-5: dot product plus capped term bonus, best first."""
    ranked = best_rows(index, stored(hybrid_queries(requests, embed), "queries"), dim)
    return _cut(ranked, requests).join(index.select("row_index", "id"), "row_index")


# ---------------------------------------------------------------- the service as one job

def totals(routed: DataFrame, index: DataFrame, matches: DataFrame) -> DataFrame:
    """AGG-6: rows each request ranges over before paging.  ``matches``: ``query_id, found``, or a row for each row found."""
    c = F.col
    sized = routed.join(scope_sizes(index), "scope", "left")
    found = matches if "found" in matches.columns else matches.groupBy("query_id").agg(F.count("*").alias("found"))
    total = F.when(c("query_mode") == "identity", c("found")).otherwise(c("total"))
    text = F.when(c("query_mode") == "outcome", X.canonical_query(c("q")))
    return sized.join(found, "query_id", "left").select(
        "query_id", "query_mode", F.coalesce(total, F.lit(0)).alias("total"), text.alias("query_text")
    )


def search(requests: DataFrame, index: DataFrame, embed: Embedder, dim: int) -> DataFrame:
    """SCH-3: all three branches of a request table.

    ``index`` comes from ``search_index``, ``with_browse_ranks`` and ``with_vectors``.  A request whose page
    is empty has one row without ``rank``, so that its ``total``, mode and text are told all the same.
    """
    routed = stored(route(prepare_requests(requests), index), "routed")  # read by every branch below
    branch = {m: routed.filter(F.col("query_mode") == m) for m in ("browse", "identity", "outcome")}
    phrases = branch["identity"].select("phrase").filter(F.col("phrase") != "").distinct()
    hits = stored(phrase_matches(phrases, identity_values(index)), "hits")  # pages and totals
    columns = ["query_id", "rank", "row_index", "id", "score"]
    pages = (
        browse_pages(branch["browse"], index).select(*columns)
        .unionByName(identity_pages(branch["identity"], hits, index).select(*columns))
        .unionByName(hybrid_pages(branch["outcome"], index, embed, dim).select(*columns))
    )
    return totals(routed, index, identity_totals(branch["identity"], hits, index)).join(pages, "query_id", "left").select(*RESULT)


# ---------------------------------------------------------------- VEC-3, the second service

def semantic_search(requests: DataFrame, rows: DataFrame, embed: Embedder, dim: int, browser: bool = False) -> DataFrame:
    """Pure dot-product order.  ``rows``: a stored table of ``row_index, id, category_label, embedding``.

    A text may also be told as ``query`` or ``text``, a category as ``type``, a limit as ``k``.  The service compares a
    request's trimmed category with a row's own; ``browser`` has the rule of the page, which trims both (FLT-4).
    A request whose page is empty has one row without ``rank``.
    """
    c = F.col
    scope = F.lower(X.strip_space(X.first_filled(*named(requests, "category", "type"), F.lit("all"))))
    limits = [F.nullif(limit, F.lit(0)) for limit in named(requests, "limit", "k")]
    asked = requests.select(
        "query_id", X.strip_space(X.first_filled(*named(requests, "q", "query", "text"), F.lit(""))).alias("q"),
        F.when(scope == "all", F.lit(WHOLE)).otherwise(scope).alias("scope"),
        *clamp(c("offset"), F.coalesce(*limits), 50, 250),
    ).withColumn("need", c("offset") + c("limit"))
    own = F.lower(X.strip_space(c("category_label")) if browser else c("category_label"))
    items = rows.select("row_index", "id", "embedding", own.alias("scope"))

    texts = asked.filter(c("q") != "")
    queries = embed(texts, "q", "vector").select(
        "query_id", "need", F.when(c("scope") != WHOLE, c("scope")).alias("scope"),
        VX.unit_or_zero(c("vector")).alias("vector"),
    )
    ranked = _cut(best_rows(items, stored(queries, "queries"), dim), asked).join(items.select("row_index", "id"), "row_index")

    keys = items.select("row_index", "id", "scope")
    placed = global_rank(global_rank(keys, [], ["row_index"], "browse_rank"),
                         ["scope"], ["row_index"], "category_rank")
    listed = browse_pages(asked.filter(c("q") == ""), placed)
    columns = ["query_id", "rank", "row_index", "id", "score"]
    pages = ranked.select(*columns).unionByName(listed.select(*columns))
    sized = asked.select("query_id", "scope").join(scope_sizes(items), "scope", "left")
    return sized.select("query_id", F.coalesce("total", F.lit(0)).alias("total")).join(pages, "query_id", "left")


def growing_page(ranked: DataFrame, page: int, step: int = 50) -> DataFrame:
    """SRT-5: everything shown after ``page`` steps of scrolling."""
    return ranked.filter(F.col("rank") <= page * step)
