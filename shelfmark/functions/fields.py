"""Field extraction from semi-structured records, and the casts that go with it.

A record's open-ended part arrives as JSON text.  ``meta_fields`` turns it into a
map from normalised key to the value's JSON text, so that the text "5" and the
number 5 stay different.  All choices and casts after that are Column
expressions; one small Arrow function flattens the records that are nested.
"""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import vocabulary as V
from shelfmark.functions import text as X

_PAIRS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
_ARROW_PAIRS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_VARIANT_MAP = T.MapType(T.StringType(), T.VariantType())
_VARIANT_LIST = T.ArrayType(T.VariantType())
_EMPTY_JSON = ("null", '""', "[]", "{}")


# ---------------------------------------------------------------- FLD-2 flatten

def _flat_pairs(document: str | None) -> list[dict] | None:
    if document is None:
        return None
    try:
        pending = [("", json.loads(document))]
    except ValueError:
        return None
    found: dict[str, str] = {}
    while pending:
        path, value = pending.pop()
        dotted = path + "." if path else ""
        if isinstance(value, dict):
            children = [(dotted + key, child) for key, child in value.items()]
        else:
            found[path] = json.dumps(value, ensure_ascii=False)
            listed = value[: V.FLATTEN_LIST_ITEMS] if isinstance(value, list) else []
            children = [
                (f"{dotted}{i}", child) for i, child in enumerate(listed) if isinstance(child, (dict, list))
            ]
        pending.extend(reversed(children))
    return [{"key": key, "value": value} for key, value in found.items()]


@F.arrow_udf(_PAIRS)
def _flatten_udf(documents: pa.Array) -> pa.Array:
    return pa.array([_flat_pairs(d) for d in documents.to_pylist()], _ARROW_PAIRS)


def flat_fields(document: Column) -> Column:
    """``array<struct<key, value>>`` of dotted keys in record order; values are JSON text."""
    nested = F.substring(F.ltrim(document), F.lit(2), F.length(document)).rlike(r"[\[{]")
    entries = F.map_entries(F.from_json(F.when(~nested, document), _VARIANT_MAP))
    flat = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))
    return F.coalesce(_flatten_udf(F.when(nested, document)), flat, F.array().cast(_PAIRS))


def meta_fields(document: Column) -> Column:
    """Map from normalised key to JSON text: the first position and the last value of a key win."""

    def as_map(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["key"])
        unique = F.array_distinct(keys)
        last = F.transform(unique, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
        plain = F.transform(pairs, lambda p: p["value"])
        return F.map_from_arrays(unique, F.when(F.size(unique) == F.size(keys), plain).otherwise(last))

    fields = flat_fields(document)
    names = F.transform(
        X.normalize_each(F.transform(fields, lambda f: f["key"])), lambda k: F.replace(k, F.lit(" "), F.lit("_"))
    )
    values = F.transform(fields, lambda f: F.coalesce(f["value"], F.lit("null")))
    return X.bind(F.arrays_zip(names.alias("key"), values.alias("value")), as_map)


# ---------------------------------------------------------------- FLD-3 scalarise

def _bare(text: str | None) -> str | None:
    """The JSON text left when no list of one and no naming object is around it; null for an empty list."""
    if text is None or text[:1] not in ("[", "{"):
        return text
    try:
        outer = value = json.loads(text)
    except ValueError:
        return text
    while True:
        if isinstance(value, list) and len(value) < 2:
            inner = value[0] if value else None
        elif isinstance(value, dict):
            named = (value[key] for key in V.SCALAR_KEYS if value.get(key) not in (None, ""))
            inner = next(named, value)
        else:
            break
        if inner is value:
            break
        value = inner
    if value is outer:  # an unchanged container keeps its own text
        return text
    return None if value is None else json.dumps(value, ensure_ascii=False)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _bare_udf(lists: pa.Array) -> pa.Array:
    return pa.array([None if texts is None else [_bare(t) for t in texts] for texts in lists.to_pylist()], pa.list_(pa.string()))


def scalar_each(values: Column) -> Column:
    """``scalar`` of each JSON text of an array; arrays without a container take no detour."""
    holds = F.exists(values, lambda v: F.coalesce(v.rlike(r"^[\[{]"), F.lit(False)))
    return F.coalesce(_bare_udf(F.when(holds, values)), values)


def scalar(value: Column) -> Column:
    """JSON text of the single value behind lists of one and naming objects, null for an empty list."""
    return F.get(scalar_each(F.array(value)), F.lit(0))


# ---------------------------------------------------------------- FLD-4 field choice

_RULES = "array<struct<exact: array<string>, contains: array<string>, excludes: array<string>>>"


def _filled(value: Column) -> Column:
    return value.isNotNull() & ~value.isin(*_EMPTY_JSON)


def choose_keys(fields: Column, rules) -> Column:
    """``array<string>``: for each (exact, contains, excludes) rule the key a column is read from.

    That is an exact key in listed order, else the first key in record order with all
    the tokens of ``contains`` and none of ``excludes``.  The rules are one literal, so
    their number does not enlarge the plan.
    """
    named = [dict(zip(("exact", "contains", "excludes"), rule)) for rule in rules]
    literal = F.from_json(F.lit(json.dumps(named)), _RULES)

    def fitting(rule: Column):
        return lambda e: (
            _filled(e["value"])
            & F.forall(rule["contains"], lambda t: F.contains(e["key"], t))
            & ~F.exists(rule["excludes"], lambda t: F.contains(e["key"], t))
        )

    def pick(entries: Column, rule: Column) -> Column:
        listed = F.filter(rule["exact"], lambda k: _filled(F.element_at(fields, k)))
        fallback = F.get(F.filter(entries, fitting(rule)), F.lit(0))["key"]
        return F.coalesce(F.get(listed, F.lit(0)), fallback)

    return X.bind(F.map_entries(fields), lambda entries: F.transform(literal, lambda rule: pick(entries, rule)))


def chosen_texts(fields: Column, rules) -> Column:
    """``array<string>`` of the value each rule chooses, as it stands; ``stage`` it, then take ``scalar_each``."""
    return F.transform(choose_keys(fields, rules), lambda key: F.element_at(fields, key))


def choose_key(fields: Column, exact=(), contains=(), excludes=()) -> Column:
    return F.get(choose_keys(fields, [(exact, contains, excludes)]), F.lit(0))


# ---------------------------------------------------------------- text of a JSON value

def is_list(value: Column) -> Column:
    return F.coalesce(F.startswith(value, F.lit("[")), F.lit(False))


def _is_text(value: Column) -> Column:
    return F.coalesce(F.startswith(value, F.lit('"')), F.lit(False))


def _unquoted(value: Column) -> Column:
    bare = F.substring(value, F.lit(2), F.length(value) - 2)
    parsed = F.try_variant_get(F.try_parse_json(value), "$", "string")
    return F.when(F.contains(value, F.lit("\\")), parsed).otherwise(bare)


def scalar_text(value: Column) -> Column:
    zero = F.coalesce(value.try_cast("double") == 0, F.lit(False))
    return (
        F.when(value.isNull() | value.isin(*_EMPTY_JSON, "false"), F.lit(""))
        .when(_is_text(value), _unquoted(value))
        .when(value == "true", F.lit("True"))
        .when(zero, F.lit(""))
        .otherwise(value)
    )


def _quoted(value: Column) -> Column:
    """How a list prints one of its members."""
    text = _unquoted(value)
    both = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    mark = F.when(both, F.lit('"')).otherwise(F.lit("'"))
    word = F.when(value == "true", "True").when(value == "false", "False").when(value == "null", "None")
    return F.when(_is_text(value), F.concat(mark, text, mark)).otherwise(F.coalesce(word, value))


def json_items(value: Column) -> Column:
    """JSON text of each member of a JSON list."""
    return F.transform(F.from_json(F.when(is_list(value), value), _VARIANT_LIST), lambda v: F.to_json(v))


def text_of(value: Column) -> Column:
    """The text of a JSON value; empty for null, false, zero and empty containers."""

    def text(value: Column) -> Column:
        printed = F.concat(F.lit("["), F.array_join(F.transform(json_items(value), _quoted), ", "), F.lit("]"))
        return F.when(is_list(value) & (value != "[]"), printed).otherwise(scalar_text(value))

    return X.bind(value, text)


def item_texts(value: Column, separators: str | None = None) -> Column:
    """Texts of a JSON list's members, or of a single value (split when ``separators`` is given)."""

    def texts(value: Column) -> Column:
        single = scalar_text(value)
        other = F.split(single, separators) if separators else F.array(single)
        return F.when(is_list(value), F.transform(json_items(value), scalar_text)).otherwise(other)

    return X.bind(value, texts)


def split_terms_json(value: Column) -> Column:
    return X.split_terms_of(item_texts(value, r"[,;|/\n]"))


def rendered(post_text: Column) -> Column:
    return X.clean(X.first_filled(post_text["rendered"], post_text["raw"]))


# ---------------------------------------------------------------- FLD-5 … FLD-8 URLs

_URL_HINT = re.compile(r"""https?://[^\s"'<>]""")
_URL = r"""(?U)https?://[^\s\x1c-\x1f"'<>]+"""


def _url_in(decoded: Column) -> Column:
    return X.blank_to_null(F.rtrim(F.regexp_extract(decoded, _URL, 0), F.lit("),.;")))


def first_url(text: Column) -> Column:
    """The first absolute URL of a text, without closing punctuation; null when there is none."""
    return _url_in(X.unescape(text))


def first_url_of(texts: Column) -> Column:
    """The first URL found in a list of texts, tried in order."""
    found = F.transform(X.unescape_each(texts), _url_in)
    return F.get(F.filter(found, lambda u: u.isNotNull()), F.lit(0))


def _text_with_url(document: str | None) -> str | None:
    """The first text with a URL in a JSON value: of an object the preferred members, then all, of a list each in order."""
    try:
        pending = [json.loads(document)]
    except ValueError:
        return None
    while pending:
        value = pending.pop()
        if isinstance(value, str):
            if _URL_HINT.search(html.unescape(value)):
                return value
            continue
        if isinstance(value, dict):
            inner = [value[key] for key in V.URL_KEYS if key in value] + list(value.values())
        else:
            inner = value if isinstance(value, list) else []
        pending.extend(reversed(inner))
    return None


@F.arrow_udf(T.ArrayType(T.StringType()))
def _text_with_url_udf(lists: pa.Array) -> pa.Array:
    def found(text):
        return _text_with_url(text) if text is not None and text[:1] in ("[", "{") else text

    return pa.array([None if texts is None else [found(t) for t in texts] for texts in lists.to_pylist()], pa.list_(pa.string()))


def url_sources(values: Column) -> Column:
    """For each plain text, JSON text, object or list of an array: the text to look for a URL in."""
    holds = F.exists(values, lambda v: F.coalesce(v.rlike(r"^[\[{]"), F.lit(False)))
    plain = F.transform(values, lambda v: F.when(_is_text(v), _unquoted(v)).otherwise(v))
    return F.coalesce(_text_with_url_udf(F.when(holds, plain)), plain)


def url_source(value: Column) -> Column:
    return F.get(url_sources(F.array(value)), F.lit(0))


def extract_url(value: Column) -> Column:
    return first_url(url_source(value))


def media_sources(embedded: Column) -> list[Column]:
    """Where a featured image may be, in order: its source, its large and its medium size."""
    media = F.get(embedded["wp:featuredmedia"], F.lit(0))
    sizes = media["media_details"]["sizes"]
    return [media["source_url"], sizes["large"], sizes["medium_large"]]


def _without_dots(path: Column) -> Column:
    """An absolute path with its ``.`` and ``..`` segments resolved."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    closing = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, closing), "/"))


def absolute_url(url: Column, base: str) -> Column:
    """``url`` against a site root: absolute, scheme-relative, root-relative or relative, without dot segments."""
    root = base.rstrip("/")
    scheme = root.split(":", 1)[0]
    site = re.match(r"[^/]*//[^/]*|", root).group()  # scheme and host
    folder = root[len(site):]

    def under_site(path: Column) -> Column:
        plain, rest = F.regexp_extract(path, r"^[^?#]*", 0), F.regexp_extract(path, r"^[^?#]*([\s\S]*)$", 1)
        dotted = plain.rlike(r"/\.\.?(/|$)")
        return F.concat(F.lit(site), F.when(dotted, F.concat(_without_dots(plain), rest)).otherwise(path))

    return (
        F.when((url == "") | url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(F.startswith(url, F.lit("//")), F.concat(F.lit(scheme + ":"), url))
        .when(F.startswith(url, F.lit("/")), under_site(url))
        .otherwise(under_site(F.concat(F.lit(folder + "/"), url)))
    )


def image_path(image: Column, folder: str = "/assets/inventory/") -> Column:
    """FLD-12: where a stored image value points."""
    remote = image.rlike(r"(?i)^https?://") | F.startswith(image, F.lit("/"))
    nested = F.concat(F.lit("/"), F.regexp_replace(image, r"^\.?/", ""))
    return F.when((image == "") | remote, image).when(F.contains(image, F.lit("/")), nested).otherwise(
        F.concat(F.lit(folder), image)
    )


def row_image(image, image_url, asset, photo, image_filename, folder: str = "/assets/inventory/") -> Column:
    named = X.blank_to_null(image_filename)
    return F.coalesce(
        *[image_path(X.blank_to_null(c), folder) for c in (image, image_url, asset, photo)],
        F.concat(F.lit(folder), named),
        F.lit(""),
    )


# ---------------------------------------------------------------- FLD-9, FLD-11, FLD-13, HSH-1

def stable_id(prefix: str, *keys: Column) -> Column:
    return F.concat(F.lit(prefix), X.first_filled(*keys))


def category_label(*candidates: Column) -> Column:
    return F.coalesce(*[X.blank_to_null(c) for c in candidates], F.lit(V.UNCATEGORIZED))


def subtype_label(*candidates: Column) -> Column:
    return X.first_filled(*candidates)


def label_line(*parts: Column, fallback: str) -> Column:
    return X.first_filled(F.concat_ws(" · ", *[X.blank_to_null(p) for p in parts]), F.lit(fallback))


def asset_digest(row_id: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(row_id, F.lit("\n"), url), 256), 1, V.ASSET_DIGEST_CHARS)


# ---------------------------------------------------------------- CST-1 … CST-4

def number_of(value: Column) -> Column:
    """A JSON number (or flag) as double; null for every other kind."""
    flag = F.when(value == "true", F.lit(1.0)).when(value == "false", F.lit(0.0))
    return F.coalesce(flag, F.when(value.rlike("^-?[0-9]"), value.try_cast("double")))


def flag_word(text: Column) -> Column:
    """Three-valued reading of a word: true, false or unknown."""
    word = X.normalize(text)
    return F.when(word.isin(*V.TRUE_WORDS), True).when(word.isin(*V.FALSE_WORDS), False)


def flag_of(value: Column, text: Column | None = None) -> Column:
    return F.coalesce(number_of(value) != 0, flag_word(text_of(value) if text is None else text))


def money_number(number: Column) -> Column:
    """Whole amounts above 1000 are cents."""
    cents = (number > 1000) & (number == F.floor(number))
    return F.round(F.when(cents, number / 100).otherwise(number), 2)


def money_text(text: Column) -> Column:
    """The first amount of a text; without a dollar sign whole amounts from 1000 on are cents."""
    amount = r"(?:\$\s*)?([0-9]+(?:\.[0-9]{1,2})?)"

    def read(plain: Column) -> Column:
        found = F.regexp_extract(F.replace(plain, F.lit(","), F.lit("")), amount, 1).try_cast("double")
        bare = ~F.contains(plain, F.lit("$"))
        return X.bind(found, lambda n: F.round(F.when(bare & (n >= 1000) & (n == F.floor(n)), n / 100).otherwise(n), 2))

    return X.bind(X.clean(text), read)


def money_of(value: Column, text: Column | None = None) -> Column:
    """``text``: the value's own text, when it is already at hand."""
    told = money_text(text_of(value) if text is None else text)
    return F.coalesce(money_number(number_of(value)), F.when(number_of(value).isNull(), told))


def money_display(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9.-]", "")
    number = F.when(digits == "", F.lit(0.0)).otherwise(digits.try_cast("double"))
    shown = F.concat(F.lit("$"), F.format_string("%.2f", number))
    return F.when(text.isNull() | (text == ""), F.lit("")).otherwise(F.when(number.isNull(), text).otherwise(shown))
