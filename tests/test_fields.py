import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import fields as L
from shelfmark.functions.staging import stage


def fields_of(spark, document, build):
    df = spark.createDataFrame([(json.dumps(document) if not isinstance(document, str) else document,)], "t string")
    return stage(df.select(L.meta_fields(F.col("t")).alias("m"))).select(build(F.col("m")).alias("r")).first()["r"]


def test_flatten_nested_in_record_order(spark):
    document = {"b": [{"id": 3, "name": "N"}], "Ünï key": {"deep": {"x": 1}}, "l": ["a", 3], "e": {}}
    keys = fields_of(spark, document, F.map_keys)
    assert keys == ["b", "b_0_id", "b_0_name", "uni_key_deep_x", "l"]


def test_flatten_expands_only_ten_list_items(spark):
    keys = fields_of(spark, {"l": [{"v": i} for i in range(12)]}, F.map_keys)
    assert keys == ["l"] + [f"l_{i}_v" for i in range(10)]


def test_same_key_keeps_first_place_and_last_value(spark):
    m = fields_of(spark, {"A b": 1, "c": 2, "a_b": 3}, lambda m: m)
    assert list(m.items()) == [("a_b", "3"), ("c", "2")]


@pytest.mark.parametrize("value, expected", [
    ("[]", None), ('["x"]', '"x"'), ('["a", "b"]', '["a", "b"]'), ('{"label": "L", "id": 1}', '"L"'),
    ('{"name": "", "title": [{"value": 5}]}', "5"), ('{"z": 1, "a": 2}', '{"z": 1, "a": 2}'), ("5", "5"), (None, None),
    ('[[[[[["x"]]]]]]', '"x"'), ('[{"name": [{"title": [[{"label": "deep"}]]}]}]', '"deep"'), ('[[[]]]', None), ("[broken", "[broken"),
])
def test_scalar(one, value, expected):
    assert one(value, L.scalar) == expected


@pytest.mark.parametrize("document, rule, expected", [
    ({"x": 1, "brand": "B"}, (("product_brand", "brand"), ("brand",), ()), "brand"),
    ({"brand": "", "my_brand_name": "B"}, (("brand",), ("brand",), ()), "my_brand_name"),
    ({"brand_id": 1, "brand_label": "B"}, ((), ("brand",), ("id",)), "brand_label"),
    ({"product_width": 9}, ((), ("product", "id"), ()), "product_width"),     # tokens are substrings
    ({"a": None, "b": [], "c": {}}, ((), (), ()), None),
])
def test_choose_key(spark, document, rule, expected):
    assert fields_of(spark, document, lambda m: L.choose_key(m, *rule)) == expected


@pytest.mark.parametrize("value, expected", [
    ('"x"', "x"), ('"a\\"b"', 'a"b'), ("0", ""), ("0.0", ""), ("false", ""), ("true", "True"), ("12.5", "12.5"), ("null", ""),
    ("[]", ""), ('["a", "b\'c", 3, null, true]', "['a', \"b'c\", 3, None, True]"), (None, ""), ('"0"', "0"),
])
def test_text_of(one, value, expected):
    assert one(value, L.text_of) == expected


@pytest.mark.parametrize("value, expected", [
    ('"see http://a.b/c?x=1&amp;y=2), or"', "http://a.b/c?x=1&y=2"),
    ('"HTTP://a"', None), ("5", None),
    ('{"z": "http://z/1", "large": "http://l/2"}', "http://l/2"),
    ('{"z": "http://z/1"}', "http://z/1"),
    ('[{"id": 1}, {"src": "http:\\/\\/s/3"}]', "http://s/3"),
    ("plain http://p/4.", "http://p/4"), (None, None),
    ('{"sizes": {"thumb": "http://t/5", "full": {"url": "http://f/6"}}}', "http://f/6"),
    ('{"a": {"z": "http://z/7", "url": "http://u/8"}}', "http://u/8"),
    ('{"http://key/9": 1, "x": [[{"y": "http://y/10"}]]}', "http://y/10"), ('{"http://key/9": 1}', None), ("{broken http://b/1", None),
])
def test_extract_url(one, value, expected):
    assert one(value, L.extract_url) == expected


@pytest.mark.parametrize("value, expected", [
    ("http://x/y", "http://x/y"), ("//cdn/x", "https://cdn/x"), ("/p/1", "https://shop.example/p/1"),
    ("p/1", "https://shop.example/p/1"), (None, None), ("./a.png", "https://shop.example/a.png"), ("../a.png", "https://shop.example/a.png"),
    ("/x/./y/../z.png?q=/../r", "https://shop.example/x/z.png?q=/../r"), ("a/b/..", "https://shop.example/a/"), ("a..b/c.", "https://shop.example/a..b/c."),
])
def test_absolute_url(one, value, expected):
    assert one(value, lambda t: L.absolute_url(t, "https://shop.example/")) == expected


@pytest.mark.parametrize("value, expected", [
    ("a.webp", "/assets/inventory/a.webp"), ("./x/a.webp", "/x/a.webp"), ("/x/a", "/x/a"), ("HTTPS://x", "HTTPS://x"), ("", ""),
])
def test_image_path(one, value, expected):
    assert one(value, L.image_path) == expected


@pytest.mark.parametrize("value, expected", [
    ("true", True), ("0", False), ("2.5", True), ('"In-Stock"', True), ('"sold out"', False), ('"soon"', None), ('"2"', None),
    ("null", None), (None, None),
])
def test_flag(one, value, expected):
    assert one(value, L.flag_of) is expected


@pytest.mark.parametrize("value, expected", [
    ("1000", 1000.0), ("1001", 10.01), ("1000.5", 1000.5), ("12", 12.0), ("true", 1.0),
    ('"1000"', 10.0), ('"1,250"', 12.5), ('"$1,250"', 1250.0), ('"about 9.999"', 9.99), ('"free"', None), (None, None),
])
def test_money(one, value, expected):
    assert one(value, L.money_of) == expected


@pytest.mark.parametrize("value, expected", [
    ("12.5", "$12.50"), ("USD 3", "$3.00"), ("1.2.3", "1.2.3"), ("", ""), (None, ""), ("abc", "$0.00"),
])
def test_money_display(one, value, expected):
    assert one(value, L.money_display) == expected
