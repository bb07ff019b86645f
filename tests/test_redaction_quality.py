from pyspark.sql import functions as F

from shelfmark.operators import quality as Q
from shelfmark.operators.fingerprint import fingerprint
from shelfmark.operators.redaction import with_record_text
from shelfmark.schema import INVENTORY

BLANK = {f.name: [] if f.name in ("effects", "flavors") else None for f in INVENTORY.fields}


def texts(spark, *rows):
    df = spark.createDataFrame([tuple({**BLANK, "row_index": i, **r}[n] for n in INVENTORY.names) for i, r in enumerate(rows)], INVENTORY)
    return [r["record_text"] for r in with_record_text(df).orderBy("row_index").collect()]


def test_policy(spark):
    """Controlled words survive even inside a name; name and brand go as phrases and as words; list lines survive."""
    tin, salve = texts(
        spark,
        {"name": "Tidewater Harbour Gummy Tin", "brand": "Tidewater", "category": "edible", "subcategory": "Gummy", "form": "tin",
         "strain_type": "indica", "phenotype": "harbour cut no. 4", "lineage": "Pier x Lantern", "thc_text": "10 mg per tin",
         "flavors": ["plum", "harbour", "sea salt"], "effects": ["sleepy"],
         "description": "TIDEWATER presents a plum gummy. The Tidewater Harbour Gummy Tin holds ten; harbours are not named."},
        {"name": "Ösel No. 9 Salve", "brand": "Quill & Fern", "category": "topical", "subcategory": "Salve",
         "description": "Quill &amp; Fern made this salve with beeswax. Ask for Ösel No. 9 Salve or quill by name."},
    )
    for line in ("Product category: edible.", "Product subcategory: Gummy.", "Strain type: indica.", "Flavor and aroma profile: plum, sea salt."):
        assert line in tin
    assert "plum gummy" in tin and "harbours are not named" in tin and "Pier x Lantern" in tin and "10 mg per tin" in tin
    assert "tidewater" not in tin.lower() and "harbour cut" not in tin.lower() and "cut no. 4" in tin
    assert "Product category: topical." in salve and "salve with beeswax" in salve
    for gone in ("quill", "fern", "sel no. 9"):
        assert gone not in salve.lower()


def test_redaction_details(spark):
    got = texts(
        spark,
        # all terms redacted leaves an empty list; words are matched whole; accents in names match as phrases only
        {"name": "Mint", "brand": "", "flavors": ["mint", "MINT"], "description": "minty Mint, mint-tea", "thc_text": "mint"},
        {"name": "a.b (x)\\E+", "brand": "Zed", "form": "Tea", "category": "tea", "description": "A.B (X)\\E+ zed zedx"},
        {"name": None, "brand": None},
    )
    assert got[0] == ("Cannabis retail inventory product. Flavor and aroma profile: . Product description: y , -tea "
                      "Listed THC potency: .")
    assert got[1] == "Cannabis retail inventory product. Product category: tea. Product description: x"
    assert got[2] == "Cannabis retail inventory product."


def test_fingerprint_ignores_order_and_partitions_only(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2).cast("string").alias("s"), F.array("id").alias("a"))
    base = fingerprint(df, "v").first()
    assert fingerprint(df.repartition(7).orderBy(F.desc("id")), "v").first() == base
    assert fingerprint(df.filter("id <> 5"), "v").first()["fingerprint"] != base["fingerprint"]
    assert fingerprint(df.union(df.limit(1)), "v").first()["fingerprint"] != base["fingerprint"]
    assert fingerprint(df, "w").first()["fingerprint"] != base["fingerprint"]
    ab = spark.createDataFrame([("a|1", "b")], "x string, y string")
    ba = spark.createDataFrame([("a", "1|b")], "x string, y string")
    assert fingerprint(ab, "v").first()["fingerprint"] != fingerprint(ba, "v").first()["fingerprint"]


def test_checks_find_what_is_wrong(spark):
    rows = spark.createDataFrame([("a", False), ("b", None), ("c", True)], "id string, in_stock boolean")
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [float("nan"), 0.0]), ("b", [1.0, 0.0]), ("d", [2.0, 0.0])], "id string, embedding array<float>")
    told = spark.createDataFrame(
        [("a", "Long Name Here", "x", "has long name here inside"), ("b", "Short", "short", "short"), ("c", "None such", "", " \n")],
        "id string, name string, brand string, record_text string")
    report = Q._single(rows.limit(1), "x", F.lit(True))
    for check in (Q.none_out_of_stock(rows), Q.vector_shape(rows, vectors, 2), Q.unit_norms(vectors), Q.no_leaks(told),
                  Q.no_empty_text(told), Q.no_missing_vectors(told, vectors, 2)):
        report = report.unionByName(check)
    got = {r["check"]: (r["bad_rows"], r["sample"]) for r in report.collect()}
    assert got["stock"] == (1, ["a"])
    assert got["shape"] == (3, ["b", "c", "d"])      # two vectors, none, no row
    assert got["normalized"] == (2, ["b", "d"])
    assert got["metadata_exclusion"] == (1, ["a"])
    assert got["record_text"] == (1, ["c"])
    assert got["complete"] == (1, ["c"])
