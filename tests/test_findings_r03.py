"""One small case per finding of the third review."""

from pyspark.sql import functions as F

from curatrix.functions import text as tx
from curatrix.operators import address as ad
from curatrix.operators import selection as sel
from curatrix.operators import writing
from curatrix.plans import maintenance as plans


def test_whole_words_beside_other_letters(spark):
    rows = spark.createDataFrame([("dasßüsch",), ("dasz",), ("a das_ b",), ("ödas",), ("x and, das",)], "b string")
    got = [r.k for r in rows.select(tx.whole_word_terms(F.col("b"), ("and", "das"), "none", ascii_words=True).alias("k")).collect()]
    assert got == ["das", "none", "none", "das", "and, das"]


def test_image_sides_just_at_a_limit(spark):
    rows = spark.createDataFrame([(w, w * n // 100) for n in (110, 230) for w in range(100, 2100, 100)] + [(n * h // 100, h) for n in (85, 120) for h in range(100, 2100, 100)], "w int, h long")
    got = rows.select("w", "h", sel.image_score(F.lit("https://a.org/x.jpg"), F.col("w"), F.col("h")).alias("s")).collect()
    for r in got:
        aspect = 25 if 11 * r.w <= 10 * r.h and 10 * r.h <= 23 * r.w else 12
        assert r.s == min(40, r.w * r.h // 50000) + aspect, r


def test_address_line_of_a_candidate_is_its_place(spark):
    places = spark.range(0, 2600, 13).select(F.col("id").alias("event_id"), F.col("id").alias("place"), F.lit("2024-01-20 10:00:00").cast("timestamp_ntz").alias("ts"),
                                             F.lit("2024-01-20").cast("date").alias("start_date"), F.lit("view").alias("event_type"))
    addr = spark.range(2600).select(F.col("id").alias("address_id"), (F.col("id") % 500).cast("string").alias("street_number"), plans._street("id").alias("street_name"))
    got = ad.match_street(plans.candidates(places), addr, "row_id", "location").collect()
    assert len(got) == 200 and all(r.row_id == r.address_id for r in got)


def test_scored_lookups_see_only_what_the_street_leaves_over(spark, monkeypatch):
    seen = []

    def quick(df, addr, key, *rest):
        seen.extend(r[0] for r in df.select(key).collect())
        return df.select(key, F.lit(7).cast("long").alias("address_id"))

    monkeypatch.setattr(ad, "quick_lookup", quick)
    df = spark.createDataFrame([(1, "12 Oak Street", "a", ""), (2, "Somewhere", "b", "")], "row_id long, location string, event_name string, description string")
    addr = spark.createDataFrame([(5, "Hall", "12", "Oak")], "address_id long, building_name string, street_number string, street_name string")
    located, _ = writing.locate(df, addr, writing.WriteRules(F.current_date()))
    assert {(r.row_id, r.address_id) for r in located.collect()} == {(1, 5), (2, 7)} and seen == [2]


def test_quick_lookup_on_a_street_of_many_names(spark):
    word = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    a = spark.createDataFrame([(i, f"Name{word(i)} Hall", f"Name{word(i)} Hall, 12 Oak St", "12", "oak") for i in range(50)] + [(90, "Ab", "", "12", "oak"), (91, "Elm House", "", "3", "elm")],
                              "address_id long, building_name string, full_address string, street_number string, street_name string")
    said = ["NAMEAH HALL, 12 OAK ST", "Namebf Hall, 12 Oak Street", "Ab, 12 Oak Street", "Other, 12 Oak Street", "x, 3 Elm Street"]
    df = spark.createDataFrame([(10 * n + k, t) for n in range(2) for k, t in enumerate(said)], "k long, t string")
    want = {(10 * n + k, i, s) for n in range(2) for k, i, s in ((0, 7, 1), (1, 31, 3), (2, 90, 3), (4, 91, 2))}
    assert {(r.k, r.address_id, r.step) for r in ad.quick_lookup(df, a, "k", "t").collect()} == want
