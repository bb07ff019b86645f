"""Text functions as Column expressions.

All pattern work runs inside the JVM.  Only two things Spark lacks, Unicode
compatibility folding and HTML entity decoding, go through Arrow functions, and
only for the rows that need them: every other row sends a null, which costs a bit.

Patterns use ``(?U)`` classes or explicit ``\\p`` classes so that white space and
word edges mean the same for all Unicode text on every JDK.
"""

from __future__ import annotations

import functools
import html
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import vocabulary as V

SPACE = r"[\s\x1c-\x1f]"
# the same characters, told one by one: what patterns look up fastest and what trims take
SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"


# ---------------------------------------------------------------- Arrow helpers

@functools.cache
def _mark_pattern() -> str:
    """A character class of all combining marks, written as code point ranges."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    ranges, start = [], marks[0]
    for here, following in zip(marks, marks[1:] + [-1]):
        if following != here + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{here:x}}}")
            start = following
    return "[" + "".join(ranges) + "]"


PIECE = 1 << 20  # bytes of text that are worked on at once


def by_bytes(texts: pa.Array, most: int = PIECE) -> Iterator[pa.Array]:
    """Texts in parts of about ``most`` bytes, or of one text."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(lengths, dtype=np.int64), 0
    while first < len(texts):
        after = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield texts.slice(first, after - first)
        first = after


def _in_pieces(kernel: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """What a kernel holds beside its texts and their result is bounded, however large an Arrow batch is."""

    @functools.wraps(kernel)
    def run(values: pa.Array) -> pa.Array:
        if values.null_count == len(values):
            return values
        done = [part if part.null_count == len(part) else kernel(part).cast(values.type) for part in by_bytes(values)]
        return pa.concat_arrays(done)

    return run


@_in_pieces
def _unescape(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())


_WHOLE_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _decoded(entity: re.Match) -> str:
    told = entity[0]
    return html.unescape(told) if told[1] == "#" or told[1:] in html5 else told


@_in_pieces
def _unescape_whole(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else _WHOLE_ENTITY.sub(_decoded, v) for v in values.to_pylist()], pa.string())


@_in_pieces
def _fold(values: pa.Array) -> pa.Array:
    folded = pc.utf8_normalize(values, form="NFKD")
    folded = pc.replace_substring_regex(folded, pattern=_mark_pattern(), replacement="")
    folded = pc.replace_substring_regex(folded, pattern=r"<[^>]+>", replacement=" ")
    return _unescape(folded) if pc.any(pc.match_substring(folded, "&")).as_py() else folded


def _within_lists(kernel, lists: pa.Array) -> pa.Array:
    """``kernel`` over the texts of all lists; empty lists give null."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if not lengths.any():
        return pa.nulls(len(lists), lists.type)
    offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, kernel(lists.flatten()), mask=pa.array(lengths == 0))


@F.arrow_udf(T.StringType())
def _unescape_udf(values: pa.Array) -> pa.Array:
    return _unescape(values)


@F.arrow_udf(T.StringType())
def _unescape_whole_udf(values: pa.Array) -> pa.Array:
    return _unescape_whole(values)


@F.arrow_udf(T.StringType())
def _fold_udf(values: pa.Array) -> pa.Array:
    return _fold(values)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescape_each_udf(lists: pa.Array) -> pa.Array:
    return _within_lists(_unescape, lists)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _fold_each_udf(lists: pa.Array) -> pa.Array:
    return _within_lists(_fold, lists)


# ---------------------------------------------------------------- small pieces

def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else the empty string."""
    return F.coalesce(*[blank_to_null(t) for t in texts], F.lit(""))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when it holds an Arrow function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def one_space(text: Column) -> Column:
    """Each run of space becomes one blank; those that are one already are passed over."""
    return F.regexp_replace(text, f"[^!-~](?<! (?=[!-~]))(?<=[{SPACES}])(?<! (?![{SPACES}]))[{SPACES}]*", " ")


def has_any(text: Column, *pieces: str) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(piece)) for piece in pieces])


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def unescape(text: Column, whole_only: bool = False) -> Column:
    """As a browser, which also takes ``&amp`` without its end; with ``whole_only`` just entities that end in a semicolon."""
    udf = _unescape_whole_udf if whole_only else _unescape_udf
    return F.coalesce(udf(F.when(F.contains(text, F.lit("&")), text)), text)


def _where_any(texts: Column, test, udf) -> Column:
    """``udf`` of the lists in which ``test`` holds for a text.

    The others send an empty list: Spark's Arrow writer goes over all nulls of a batch again with each row.
    """
    hit = F.exists(texts, test)
    return F.coalesce(udf(F.when(hit, texts).otherwise(F.array().cast("array<string>"))), texts)


def unescape_each(texts: Column) -> Column:
    return _where_any(texts, lambda t: F.contains(t, F.lit("&")), _unescape_each_udf)


# ---------------------------------------------------------------- TXT-1 normalise

def _to_tokens(plain: Column) -> Column:
    spelled = F.replace(F.lower(plain), F.lit("&"), F.lit(" and "))
    # runs of other characters, but for a blank between two words
    return F.coalesce(F.btrim(F.regexp_replace(spelled, "[^a-z0-9](?<! (?=[a-z0-9]))[^a-z0-9]*", " ")), F.lit(""))


def _needs_fold(text: Column) -> Column:
    """Holds ``&`` or a character beyond ASCII."""
    return (F.octet_length(text) != F.char_length(text)) | F.contains(text, F.lit("&"))


def _without_tags(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", " ")).otherwise(text)


def normalize(text: Column) -> Column:
    """Accent-free lower-case ASCII tokens joined by one space; null gives ''."""
    folded = _fold_udf(F.when(_needs_fold(text), text))
    return _to_tokens(F.coalesce(folded, _without_tags(text)))


def normalize_each(texts: Column) -> Column:
    folded = _where_any(texts, _needs_fold, _fold_each_udf)
    return F.transform(folded, lambda t: _to_tokens(_without_tags(t)))


# ---------------------------------------------------------------- TXT-2, TXT-3 clean

# one word of each phrase: a text without any of them needs no further look
# (found by its rarest letter: a choice between words would be tried at every place)
_BOILERPLATE_HINT = (
    "(?is)[xyk:](?:(?<=x)icating|(?<=k)eep(?=.*reach)|(?<=only)(?=.*(?:adults|possessed))|(?<=dispensary)|(?<=warning:))")


def strip_boilerplate(text: Column) -> Column:
    """Each phrase takes the rest of the text with it when that rest is on the last line."""
    for phrase in V.BOILERPLATE:
        words = phrase.replace(r"\s", f"(?U:{SPACE})")
        text = strip_space(F.regexp_replace(text, f"(?id){WORD_START}{words}.*$", ""))
    return text


def _strip_if_needed(text: Column) -> Column:
    ends = [F.contains(F.lit(SPACES), F.substring(text, place, 1)) for place in (1, -1)]
    return F.when(ends[0] | ends[1], strip_space(text)).otherwise(text)


def _clean_decoded(raw: Column) -> Column:
    """All steps look at ``raw`` to see whether they have work, so plain text passes through few patterns."""
    tagged = F.contains(raw, F.lit("<"))
    lines = F.regexp_replace(raw, r"(?iU)<br\s*/?>", "\n")
    lines = F.regexp_replace(lines, r"(?i)</(?:p|div|li|h[1-6])>", "\n")
    bare = F.regexp_replace(F.when(tagged, F.regexp_replace(lines, r"<[^>]+>", " ")).otherwise(raw), r"[ \t\xa0]+", " ")
    text = F.when(tagged | has_any(raw, "  ", "\t", "\xa0"), bare).otherwise(raw)
    squeezed = F.regexp_replace(text, rf"(?U)\n{SPACE}*\n+", "\n")
    text = bind(F.when(tagged | F.contains(raw, F.lit("\n")), squeezed).otherwise(text), _strip_if_needed)
    return F.when(raw.rlike(_BOILERPLATE_HINT), strip_boilerplate(text)).otherwise(text)


def clean(text: Column, whole_only: bool = False) -> Column:
    """Readable text of an HTML fragment; null gives ''."""
    return F.coalesce(_clean_decoded(unescape(text, whole_only)), F.lit(""))


def clean_each(texts: Column) -> Column:
    return F.transform(unescape_each(texts), lambda t: F.coalesce(_clean_decoded(t), F.lit("")))


# ---------------------------------------------------------------- TXT-4 terms

def split_terms_of(items: Column) -> Column:
    """Cleaned terms without empty words; spellings of one normal form keep the first."""
    terms = F.transform(clean_each(items), lambda t: strip_chars(t, " .:-"))
    pairs = F.arrays_zip(terms.alias("term"), normalize_each(terms).alias("key"))
    kept = F.filter(pairs, lambda p: (p["key"] != "") & ~p["key"].isin(*V.EMPTY_TERMS))

    def first_spellings(pairs: Column) -> Column:
        """Sorting by key brings equal keys together; sorting by place restores the order."""
        placed = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["term"].alias("term")))

        def heads(ordered: Column) -> Column:
            first = F.filter(ordered, lambda p, i: (i == 0) | (p["key"] != F.get(ordered, i - 1)["key"]))
            return F.array_sort(F.transform(first, lambda p: F.struct(p["i"].alias("i"), p["term"].alias("term"))))

        return F.transform(bind(F.array_sort(placed), heads), lambda p: p["term"])

    return F.coalesce(bind(kept, first_spellings), F.array().cast("array<string>"))


def split_terms(text: Column) -> Column:
    return split_terms_of(F.split(F.coalesce(text, F.lit("")), r"[,;|/\n]"))


# ---------------------------------------------------------------- TXT-5 sections

def labelled_sections(text: Column, wanted, labels=V.SECTION_LABELS) -> Column:
    """``array<string>``: for each wanted label the text after ``LABEL:`` up to the next other label or the end."""
    raw = []
    for label in wanted:
        stops = "|".join(other for other in labels if other != label)
        pattern = rf"(?isU){WORD_START}{label}{SPACE}*:{SPACE}*(.*?)(?={WORD_START}(?:{stops}){SPACE}*:|$)"
        raw.append(F.regexp_extract(text, pattern, 1))
    return F.transform(clean_each(F.array(*raw)), lambda t: strip_chars(t, " .;:-"))


def labelled_section(text: Column, label: str, labels=V.SECTION_LABELS) -> Column:
    return F.get(labelled_sections(text, [label], labels), F.lit(0))


# ---------------------------------------------------------------- TXT-8 … TXT-11 search text

def words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def terms_of_normal(normal: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in V.STOPWORDS])
    return F.filter(
        F.split(normal, " "),
        lambda t: (F.length(t) >= V.MIN_TERM_CHARS) & ~F.array_contains(stop, t),
    )


def meaningful_terms(text: Column) -> Column:
    return terms_of_normal(normalize(text))


def descriptor_text(fields: list[Column], effects: Column, flavors: Column) -> Column:
    empty = F.array().cast("array<string>")
    texts = [F.coalesce(f, F.lit("")) for f in fields]
    return normalize(F.concat_ws(" ", *texts, F.coalesce(effects, empty), F.coalesce(flavors, empty)))


def expand_intent(query: Column) -> Column:
    """Drop one leading request phrase and the articles, then append known descriptors."""

    def without_prefix(normal: Column) -> Column:
        bodies = [
            F.when(F.startswith(normal, F.lit(prefix)), F.substring(normal, F.lit(len(prefix) + 1), F.length(normal)))
            for prefix in V.QUERY_PREFIXES
        ]
        kept = F.filter(words(F.coalesce(*bodies, normal)), lambda w: ~w.isin(*V.ARTICLES))
        return F.array_join(kept, " ")

    def with_descriptors(bare: Column) -> Column:
        added = [F.when(F.contains(bare, F.lit(phrase)), F.lit(more)) for phrase, more in V.PHRASE_EXPANSIONS]
        return F.btrim(F.concat_ws(" ", bare, *added))

    return bind(bind(normalize(query), without_prefix), with_descriptors)


def canonical_query(query: Column) -> Column:
    before, after = V.QUERY_TEMPLATE
    return F.concat(F.lit(before), expand_intent(query), F.lit(after))
