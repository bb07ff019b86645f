"""The short ways of the text functions give what the plain patterns give."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.functions import text as X


def test_short_ways_equal_the_patterns(spark):
    letters, source = " \t\n\x1c\xa0\u3000ab,&<>9\xe9", random.Random(5)
    made = [("".join(source.choices(letters, k=source.randint(0, 9))),) for _ in range(5000)]
    t = F.col("t")
    strip = F.regexp_replace(t, rf"(?U)^{X.SPACE}+|{X.SPACE}+$", "")
    spelled = F.regexp_replace(F.replace(F.lower(t), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    pairs = [
        (strip, X.strip_space(t)), (strip, X._strip_if_needed(t)), (F.regexp_replace(t, rf"(?U){X.SPACE}+", " "), X.one_space(t)),
        (F.btrim(spelled), X._to_tokens(t)), (t.rlike(r"[^\x00-\x7F]|&"), X._needs_fold(t))]
    rows = spark.createDataFrame([*made, *[(c,) for c in X.SPACES]], "t string")
    assert rows.select(*[F.count_if(~a.eqNullSafe(b)) for a, b in pairs]).first() == (0,) * len(pairs)


def test_hint_finds_every_phrase(spark):
    phrases = ["This product has INTOXICATING effects", "for use ONLY by\n adults", "Keep out of  reach of children", "License dispensary",
               "cannabis products may only  be possessed", "wArning: x"]
    rows = spark.createDataFrame([(p,) for p in phrases], "t string")
    assert rows.where(F.col("t").rlike(X._BOILERPLATE_HINT)).count() == len(phrases)
    assert rows.sparkSession.createDataFrame([("reach the adults",)], "t string").where(F.col("t").rlike(X._BOILERPLATE_HINT)).count() == 0


def test_lists_without_work_come_back_as_nulls():
    assert X._within_lists(lambda texts: texts, pa.array([[], ["a"], []])).to_pylist() == [None, ["a"], None]
