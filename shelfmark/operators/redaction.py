"""Identity-free record text: what is embedded must not hold a row's own name or brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import vocabulary as V
from shelfmark.functions import text as X
from shelfmark.functions.staging import stage

_CONTROLLED = ("category", "subcategory", "form", "strain_type")
_FREE = ("phenotype", "lineage", "description", "thc_text", "cbd_text")


def protected_words(*controlled: Column) -> Column:
    """TXT-7: fixed format words plus the words of the row's own controlled fields."""
    own = [F.split(text, " ") for text in controlled]
    return F.array_union(F.array(*[F.lit(w) for w in V.PROTECTED_WORDS]), F.array_distinct(F.flatten(F.array(*own))))


def blocked_pattern(phrases: list[Column], protected: Column) -> Column:
    """A pattern of the identity words of a row, or null when there are none."""
    words = F.array_except(F.flatten(F.array(*[F.split(p, " ") for p in phrases])), protected)
    words = F.filter(words, lambda w: F.length(w) >= V.MIN_TERM_CHARS)
    pattern = F.concat(F.lit(f"(?iu){X.WORD_START}(?:"), F.array_join(words, "|"), F.lit(f"){X.WORD_END}"))
    return F.when(F.size(words) > 0, pattern)


def phrase_pattern(phrase: Column) -> Column:
    """A pattern matching the phrase literally in any case, or null for a blank phrase."""
    quoted = F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.when(phrase != "", F.concat(F.lit("(?iu)\\Q"), quoted, F.lit("\\E")))


def redact(text: Column, patterns: list[Column]) -> Column:
    for pattern in patterns:
        text = F.when(pattern.isNull(), text).otherwise(F.regexp_replace(text, pattern, F.lit(" ")))
    return X.strip_chars(X.one_space(text), " .,:;-\n")


def with_record_text(rows: DataFrame, column: str = "record_text") -> DataFrame:
    """TXT-6.  Works in narrow steps, so each cleaned field is computed once."""
    c = F.col
    texts, named = ("name", "brand", *_CONTROLLED, *_FREE), ("name", "brand", *_CONTROLLED)
    # one list per step, so each expression stands in the plan once
    listed_texts = stage(rows.select("*", X.clean_each(F.array(*[c(f) for f in texts])).alias("__t"),
                                     *[X.clean_each(c(f)).alias(f"__{f}") for f in ("flavors", "effects")]))
    listed_names = stage(listed_texts.select("*", X.normalize_each(F.slice("__t", 1, len(named))).alias("__n")))
    normal = stage(listed_names.select(
        "*", *[c("__t")[i].alias(f"__{f}") for i, f in enumerate(texts)],
        *[c("__n")[i].alias(f"__n_{f}") for i, f in enumerate(named)]))
    protected = protected_words(*[c(f"__n_{f}") for f in _CONTROLLED])
    patterned = stage(normal.select(
        "*",
        phrase_pattern(c("__name")).alias("__p_name"), phrase_pattern(c("__brand")).alias("__p_brand"),
        blocked_pattern([c("__n_name"), c("__n_brand")], protected).alias("__p_words"),
    ))
    patterns = [c("__p_name"), c("__p_brand"), c("__p_words")]

    def listed(field: str) -> Column:
        shown = F.transform(f"__{field}", lambda t: redact(t, patterns))
        return F.array_join(F.filter(shown, lambda t: t != ""), ", ")

    def line(before: str, present: Column, value: Column, after: str = ".") -> Column:
        return F.when(present, F.concat(F.lit(before), value, F.lit(after)))

    def filled(field: str) -> Column:
        return F.coalesce(c(field), F.lit("")) != ""

    def controlled(before: str, field: str, more: Column | None = None) -> Column:
        present = c(f"__{field}") != ""
        return line(before, present if more is None else present & more, c(f"__{field}"))

    own_format = (c("__n_form") != c("__n_category")) & (c("__n_form") != c("__n_subcategory"))
    description = redact(c("__description"), patterns)
    text = F.concat_ws(
        " ",
        F.lit(V.RECORD_LEAD),
        controlled("Product category: ", "category"),
        controlled("Product subcategory: ", "subcategory"),
        controlled("Format: ", "form", own_format),
        controlled("Strain type: ", "strain_type"),
        line("Phenotype: ", filled("phenotype"), redact(c("__phenotype"), patterns)),
        line("Lineage: ", filled("lineage"), redact(c("__lineage"), patterns)),
        line("Flavor and aroma profile: ", F.coalesce(F.size("flavors"), F.lit(0)) > 0, listed("flavors")),
        line("Reported effect profile: ", F.coalesce(F.size("effects"), F.lit(0)) > 0, listed("effects")),
        line("Product description: ", description != "", description, ""),
        line("Listed THC potency: ", filled("thc_text"), redact(c("__thc_text"), patterns)),
        line("Listed CBD potency: ", filled("cbd_text"), redact(c("__cbd_text"), patterns)),
    )
    return patterned.withColumn(column, text).select(*rows.columns, column)
