"""Schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_STRINGS = T.ArrayType(_S)
_RENDERED = T.StructType([T.StructField("rendered", _S), T.StructField("raw", _S)])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Open-ended parts (`meta`, image sizes) stay JSON text: the JSON reader keeps their key order.
RAW_POST = T.StructType([
    T.StructField("id", _L),
    T.StructField("title", _RENDERED),
    T.StructField("content", _RENDERED),
    T.StructField("excerpt", _RENDERED),
    T.StructField("meta", _S),
    T.StructField("_embedded", T.StructType([
        T.StructField("wp:featuredmedia", T.ArrayType(T.StructType([
            T.StructField("source_url", _S),
            T.StructField("media_details", T.StructType([
                T.StructField("sizes", T.StructType([
                    T.StructField("large", _S), T.StructField("medium_large", _S),
                ])),
            ])),
        ]))),
    ])),
    T.StructField("link", _S),
    T.StructField("modified_gmt", _S),
    T.StructField("modified", _S),
])

LOOKUP_POST = T.StructType([T.StructField("id", _L), T.StructField("title", _RENDERED)])

CATALOGUE = _struct(
    id=_S, wp_id=_L, jane_product_id=_S, sku=_S, name=_S, brand=_S, category=_S,
    subcategory=_S, form=_S, strain=_S, strain_type=_S, description=_S, effects=_STRINGS,
    flavors=_STRINGS, phenotype=_S, lineage=_S, thc_text=_S, cbd_text=_S, price=_D, unit=_S,
    in_stock=_B, image_url=_S, product_url=_S, modified_gmt=_S, source=_S, source_site=_S,
)
INVENTORY = T.StructType(CATALOGUE.fields + [T.StructField("image", _S), T.StructField("row_index", _L)])

VECTOR = _struct(id=_S, text_hash=_S, embedding=T.ArrayType(T.FloatType()))

REQUEST = _struct(query_id=_L, q=_S, category=_S, offset=T.IntegerType(), limit=T.IntegerType())

DESIGN_REQUEST = _struct(
    request_id=_L, intent=_S, path=_S, thc=_S, duration=_S, route=_S, guardrails=_STRINGS,
)

LIBRARY = T.StructType([
    T.StructField(name, _STRINGS if name == "markers" else _S)
    for name in ("name", "source", "class", "evidence", "profile", "markers", "guardrail")
])
