"""Texts of an effect design: target, library entry, signature and programme."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import vocabulary as V


def _sentence(before: str, value: Column, after: str = ".") -> Column:
    return F.concat(F.lit(before), value, F.lit(after))


def target_text(intent, path, thc, duration, route, guardrails) -> Column:
    path_text = F.lit(None).cast("string")
    for name, words in V.PATH_TEXT.items():
        path_text = F.when(path == name, F.lit(words)).otherwise(path_text)
    avoided = _sentence("Hard guardrails: avoid ", F.array_join(guardrails, ", "))
    return F.concat_ws(
        " ",
        _sentence("Desired human state: ", intent),
        path_text,
        _sentence("THC architecture: ", thc),
        _sentence("Desired duration: ", duration),
        _sentence("Preferred route or format: ", route),
        F.when(F.size(guardrails) > 0, avoided).otherwise(F.lit(V.NO_GUARDRAILS_TEXT)),
        F.lit(V.TARGET_CLOSING),
    )


def library_text(profile, evidence, guardrail) -> Column:
    return F.concat(profile, F.lit(". Evidence posture: "), evidence, F.lit(". Guardrail: "), guardrail)


def signature(path, thc, duration, route, guardrails) -> Column:
    def row(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.alias("value"))

    listed = F.upper(F.array_join(guardrails, " · "))
    return F.array(
        row("DEVELOPMENT PATH", F.when(path == "both", F.lit("CULTIVAR + BOTANICAL")).otherwise(F.upper(path))),
        row("THC ARCHITECTURE", F.upper(thc)),
        row("DURATION", F.upper(duration)),
        row("FORMAT", F.upper(route)),
        row("GUARDRAILS", F.when(F.size(guardrails) > 0, listed).otherwise(F.lit("CONSISTENCY · LOW VARIANCE"))),
    )


def _with_names(template: str, names: Column) -> Column:
    before, after = template.split("{names}")
    return F.concat(F.lit(before), names, F.lit(after))


def programme(path, item_names, library_names, instrument: str) -> Column:
    """Five steps; names the best two catalogue rows and the best three library entries."""
    filled = F.filter(F.slice(item_names, 1, 2), lambda n: n.isNotNull() & (n != ""))
    items = F.when(F.size(filled) > 0, F.array_join(filled, " + ")).otherwise(F.lit(V.STEP_1_NO_NAMES))
    short = F.transform(
        F.slice(library_names, 1, 3),
        # only the first occurrence of each suffix goes
        lambda n: F.regexp_replace(F.regexp_replace(n, "(?s)^(.*?) MATRIX", "$1"), "(?s)^(.*?) CHASSIS", "$1"),
    )
    botanical = path == "botanical"
    return F.array(
        F.when(botanical, F.lit(V.STEP_1_BOTANICAL)).otherwise(_with_names(V.STEP_1_OTHER, items)),
        F.when(path == "cultivar", F.lit(V.STEP_2_CULTIVAR)).otherwise(
            _with_names(V.STEP_2_OTHER, F.array_join(short, " + "))
        ),
        F.when(botanical, F.lit(V.STEP_3_BOTANICAL)).otherwise(F.lit(V.STEP_3_OTHER)),
        F.lit(V.STEP_4),
        F.lit(V.STEP_5.format(instrument=instrument)),
    )
