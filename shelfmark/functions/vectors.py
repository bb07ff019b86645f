"""Vector arithmetic on ``array<float>`` columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import vocabulary as V


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit(vector: Column, epsilon: float = V.NORM_EPSILON) -> Column:
    """VEC-1.  The norm is bound to a lambda variable so that it is computed once per row."""
    length = F.greatest(norm(vector), F.lit(epsilon))
    return F.flatten(F.transform(F.array(length), lambda n: F.transform(vector, lambda x: x.cast("double") / n)))


def unit_or_zero(vector: Column) -> Column:
    """The variant that leaves a zero vector as it is."""
    return F.when(norm(vector) == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(unit(vector, 0.0))


def is_finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def is_complete(vector: Column, dim: int | None = None) -> Column:
    """FLT-5: finite, long enough and, when ``dim`` is given, of the right size."""
    sized = F.lit(True) if dim is None else F.size(vector) == dim
    return F.coalesce(sized & is_finite(vector) & (norm(vector) > V.COMPLETE_NORM_FLOOR), F.lit(False))


def payload_vectors(payload: Column) -> Column:
    """VEC-8: the vectors of one recorded embedding response, ``array<array<double>>``.

    The list is looked for under ``vectors``, ``embeddings`` and ``data`` (also one
    object deeper), then a single vector under ``embedding`` or ``vector``.
    """
    doc = F.try_parse_json(payload)

    def member(*path: str) -> Column:
        return F.try_variant_get(doc, "$." + ".".join(path), "array<variant>")

    listed = ("vectors", "embeddings", "data")
    rows = [member(key) for key in listed]
    rows += [member(outer, inner) for outer in listed for inner in listed]
    rows = F.coalesce(*[F.when(F.size(r) > 0, r) for r in rows])
    read = F.transform(
        rows,
        lambda row: F.coalesce(
            F.try_variant_get(row, "$", "array<double>"),
            F.try_variant_get(row, "$.embedding", "array<double>"),
            F.try_variant_get(row, "$.vector", "array<double>"),
        ),
    )
    singles = []
    for key in ("embedding", "vector"):
        singles.append(F.try_variant_get(doc, f"$.{key}", "array<array<double>>"))
        singles.append(F.array(F.try_variant_get(doc, f"$.{key}", "array<double>")))
    singles = [F.when(~F.exists(s, lambda v: v.isNull()), s) for s in singles]
    return F.coalesce(read, *singles)
