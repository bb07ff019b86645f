import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import fields as L
from shelfmark.operators import catalogue as C
from shelfmark.operators import embedding as E
from shelfmark.operators import quality as Q
from shelfmark.plans import jobs as J
from shelfmark.sources import readers as R

BASE = "https://shop.example"


def post(i, meta, title="T", content="", **more):
    return {"id": i, "title": {"rendered": title}, "content": {"rendered": content}, "excerpt": {"rendered": ""},
            "meta": meta, "link": f"/p/{i}", "modified_gmt": "2026-01-01", **more}


POSTS = [
    post(1, {"product_brand": 7, "category": [{"id": 1}], "strain": "Haze", "price": 1250, "in_stock": True,
             "product_id": "J1", "image": {"url": "http://img/1.png"}, "effects": ["Calm", "none", "calm"]},
         title="Mint &amp; Tea", content="<p>EFFECT PROFILE: happy, bright</p><p>LINEAGE: A x B.</p>"),
    post(2, {"product_brand": ["7", "99", "House"], "in_stock": "Sold out", "product_id": "J1", "thc": 0,
             "joint_product_category": "4"}, modified_gmt="2026-02-01"),
    post(3, {"sku": "S3", "brand": "Own &amp; Co", "price": "$1,250", "in_stock": "soon", "weight": "3.5g",
             "product_description": "Kept. Warning: x", "flavors": "mint; Mint / tea"}, content='<img src="http://img/3.png">'),
    post(4, [], title="Bare", _embedded={"wp:featuredmedia": [{"media_details": {"sizes": {"large": {"source_url": "http://img/4.png"}}}}]}),
    post(5, {"sku": "S3", "in_stock": 1}, title="Tie"),
    post(6, {"in_stock": 0}, title="Gone", content="http://img/6.png"),
]
LOOKUPS = {
    "brands": [{"id": 7, "title": {"rendered": "Brand &amp; 7"}}, {"id": 8, "title": {"rendered": " "}}],
    "categories": [{"id": 1, "title": {"rendered": "Tea"}}, {"id": 4, "title": {"raw": "Box"}}],
}


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    (root / "products").mkdir()
    (root / "products" / "page1.json").write_text(json.dumps(POSTS[:4]))
    (root / "products" / "page2.json").write_text(json.dumps(POSTS[4:]))
    for name, posts in LOOKUPS.items():
        (root / name).mkdir()
        (root / name / "page1.json").write_text(json.dumps(posts))
    return root


@pytest.fixture(scope="module")
def rows(spark, site):
    lookups = {n: C.lookup_names(R.read_auxiliary(spark, str(site / n))) for n in ("brands", "categories", "strains")}
    posts = R.read_posts(spark, str(site / "products"))
    return C.normalize_posts(posts, lookups, BASE, "x-", "src").cache()


def test_normalize_posts(rows):
    got = {r["wp_id"]: r.asDict() for r in rows.collect()}
    one, two, three, four = got[1], got[2], got[3], got[4]
    assert (one["id"], one["name"], one["brand"], one["category"]) == ("x-J1", "Mint & Tea", "Brand & 7", "Tea")
    assert (one["strain"], one["price"], one["in_stock"]) == ("Haze", 12.5, True)
    assert (one["effects"], one["lineage"], one["image_url"]) == (["happy", "bright"], "A x B", "http://img/1.png")
    assert one["product_url"] == BASE + "/p/1"
    assert two["brand"] == "Brand & 7, House"        # 99 has no name and is dropped
    assert (two["category"], two["in_stock"], two["thc_text"]) == ("Box", False, None)
    assert (three["id"], three["brand"], three["price"], three["unit"]) == ("x-S3", "Own & Co", 1250.0, "3.5g")
    assert (three["in_stock"], three["description"], three["flavors"]) == (None, "Kept.", ["mint", "tea"])
    assert three["image_url"] == "http://img/3.png"
    assert (four["id"], four["category"], four["image_url"]) == ("x-4", "Cannabis", "http://img/4.png")
    assert four["jane_product_id"] is None and four["effects"] == []


def test_lookups_need_no_unique_key(spark):
    """Equal and null keys, repeated rows, and names by the thousand: each row gets its own names."""
    item = "array<struct<key: bigint, text: string>>"
    data = [("a", [(5, "")], [(6, "")]), ("a", [(6, ""), (5, ""), (6, "")], []), (None, [(None, "Own"), (9, "")], None), (None, None, [(5, "")]), ("a", [(5, "")], [(6, "")])]
    rows = spark.createDataFrame(data, f"wp_id string, brand {item}, kind {item}")
    for extra in (0, 5000):
        names = spark.createDataFrame([(5, "five"), (6, "six"), *((k, str(k)) for k in range(100, 100 + extra))], "key bigint, name string")
        got = C.resolve_lookups(rows, {"brand": "brands", "kind": "kinds"}, {"brands": names, "kinds": names}).collect()
        assert sorted(map(tuple, got), key=str) == sorted([("a", "five", "six"), ("a", "six, five", ""), (None, "Own", ""), (None, "", "five"), ("a", "five", "six")], key=str)


def test_dedupe_then_stock(rows):
    kept = {r["wp_id"] for r in C.dedupe(rows).collect()}
    assert kept == {2, 3, 4, 6}                      # newest J1; first seen of the S3 tie
    left = {r["wp_id"] for r in C.drop_out_of_stock(C.dedupe(rows)).collect()}
    assert left == {3, 4}                            # the newer sold-out version hides the older one
    assert C.drop_out_of_stock(rows, True).count() == 6


def test_chosen_keys(spark, site):
    keys = C.chosen_keys(R.read_posts(spark, str(site / "products")))
    assert keys.filter("id = 2").first()["category"] == "joint_product_category"


def test_snapshot_must_be_a_list_of_posts(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"error": "nope"}')
    with pytest.raises(Exception, match="not a list of posts"):
        R.read_posts(spark, str(tmp_path)).select("id").collect()
    assert R.read_auxiliary(spark, str(tmp_path / "absent")).count() == 0


@pytest.fixture(scope="module")
def built(spark, site, rows, tmp_path_factory):
    out, assets = str(tmp_path_factory.mktemp("out")), site / "assets"
    assets.mkdir()
    ready = C.drop_out_of_stock(C.dedupe(rows))
    names = [r["d"] for r in ready.select(L.asset_digest(F.col("id"), F.col("image_url")).alias("d")).collect()]
    (assets / f"{names[0]}.webp").write_bytes(b"x" * 600)
    (assets / f"{names[1]}.webp").write_bytes(b"x" * 10)     # a stub does not count
    (assets / f"{names[1]}.download").write_bytes(b"x" * 900)
    options = J.CatalogueOptions(
        base=BASE, products=str(site / "products"), assets=str(assets),
        lookups={n: str(site / n) for n in LOOKUPS}, id_prefix="x-", minimum=1)
    return J.build_catalogue(spark, options, out), options, out


def test_build_catalogue(spark, built):
    inventory, options, out = built
    assert inventory.count() == 1 and inventory.first()["image"].startswith("assets/inventory/")
    manifest = spark.read.json(f"{out}/manifest").first()
    assert [manifest[n] for n in ("raw_products", "deduped_products", "searchable_products", "missing_image_products")] == [6, 4, 1, 1]
    assert spark.read.json(f"{out}/rejects").first()["image_error"] == "no usable image file"
    public = spark.read.json(f"{out}/catalogue")
    assert len(public.columns) == 17
    assert J.build_catalogue(spark, options, out).count() == 1        # reused


def test_minimum_gate(spark, built, tmp_path):
    _, options, _ = built
    strict = J.CatalogueOptions(**{**options.__dict__, "minimum": 2, "refresh": True})
    with pytest.raises(C.TooFewRows):
        J.build_catalogue(spark, strict, str(tmp_path))
    assert not (tmp_path / "inventory").exists()


def test_build_resume_and_verify_field(spark, built, tmp_path):
    inventory, options, _ = built
    calls = spark.sparkContext.accumulator(0)
    base = E.hashing_model(8)

    def model(texts):
        calls.add(len(texts))
        return base(texts)

    out = str(tmp_path / "field")
    first = J.build_field(spark, inventory, out, model, "m", 8)
    assert first.count() == inventory.count() and calls.value == inventory.count()
    J.build_field(spark, inventory, out, model, "m", 8)
    assert calls.value == inventory.count()                            # reused, nothing embedded again
    J.build_field(spark, inventory, out, model, "m2", 8)
    assert calls.value == 2 * inventory.count()                        # another model starts anew
    J.build_field(spark, inventory, out, model, "m", 8)
    assets = R.read_assets(spark, options.assets)
    report = J.verify_field(spark, inventory, J.build_field(spark, inventory, out, model, "m", 8), f"{out}/manifest", assets, 8)
    assert report.filter("passed").count() == 10
    with pytest.raises(Q.ChecksFailed, match="images"):
        J.verify_field(spark, inventory, first, f"{out}/manifest", assets.limit(0), 8)
