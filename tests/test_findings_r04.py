"""One small case per finding of FINDINGS_r03.md."""

from pyspark.sql import functions as F

from curatrix.functions import fuzzy as fz
from curatrix.functions import html
from curatrix.operators import address as ad
from curatrix.operators import keyed
from curatrix.operators import replay
from curatrix.operators import rules as rl
from curatrix.plans import calendar_rules as calendar_plans
from curatrix.plans import pages as page_plans
from curatrix.plans import search as search_plans
from curatrix.plans import load_all, registry


def test_training_rows_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def seen(i):
        made.add(1)
        return i

    rows = spark.range(40).select(F.udf(seen, "long")("id").alias("doc_id"), F.array(F.concat(F.lit("w"), (F.col("id") % 4).cast("string"))).alias("tokens"),
                                  F.when(F.col("id") % 2 == 0, "good").otherwise("poor").alias("label"))
    monkeypatch.setattr(page_plans, "_training", lambda spark, d: rows)
    got = registry.QUERIES["classifier_predictions"](spark, "").collect()
    assert made.value == 40 and len(got) == 40 and all(r.label == r.predicted for r in got)


def test_contained_needles_of_each_kind(spark):
    texts = ["", None, "one", "someone, two!!", "a b-c d", "!!", "x!! y", "no on e", "bone two three", "two three", "éone"]
    needles = ["one", "two!!", "b-c", "!!", " y", "on e", "one two three", "two three", "", "e", ", "]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, b string")
    for some in (needles, ["one two three"], ["one", "e"], ["!!"], [""], []):
        n = spark.createDataFrame([(k, x) for k, x in enumerate(needles) if x in some], "k int, n string")
        got = sorted((r.i, r.k) for r in rl.contained_in_text(docs, "i", "b", n, "k", "n").collect())
        assert got == [(i, k) for i, t in enumerate(texts) for k, x in enumerate(needles) if x and x in some and t and x in t]


def test_keywords_few_and_many(spark, monkeypatch):
    texts = [("salsa  Bachata", "x"), ("nothing", None), (None, "SALSA"), ("sals", "a"), ("salsa  Bachata", "x")]
    df = spark.createDataFrame([(i, t, s, "old") for i, (t, s) in enumerate(texts)], "i int, t string, s string, tags string")
    words = spark.createDataFrame([("Salsa",), ("bachata",), ("salsa",), ("",), ("no",)], "keyword string")
    want = [(0, "bachata, salsa", True), (1, "no", True), (2, "salsa", True), (3, "old", False), (4, "bachata, salsa", True)]
    few = rl.tag_by_keywords(df, words, ["t", "s"], "tags")
    # few keywords need no shuffle of texts
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rl, "FEW", 2)
    for got in (few, rl.tag_by_keywords(df, words, ["t", "s"], "tags")):
        assert sorted((r.i, r.tags, r.changed) for r in got.collect()) == want


def most_rows(df):
    """The largest number of rows that a step of the plan of ``df`` makes."""
    session = df.sparkSession
    session.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        execution = df._jdf.queryExecution()
        execution.executedPlan().executeCollect()

        def walk(plan):
            metric = plan.metrics().get("numOutputRows")
            below = plan.children()
            return max([metric.get().value() if metric.isDefined() else 0, *(walk(below.apply(i)) for i in range(below.size()))])

        return walk(execution.executedPlan())
    finally:
        session.conf.set("spark.sql.adaptive.enabled", "true")


def test_address_tiers_meet_distinct_names(spark):
    n = 200
    p = spark.range(n).select(F.col("id").alias("k"), F.lit("Grand Hall").alias("building_name"), F.lit("12").alias("street_number"), F.lit("Oak").alias("street_name"))
    extra = spark.createDataFrame([(900, "", "5", "Elm"), (901, "", "6", "Elm"), (902, "", "7", "elm"), (903, "Far", "12", "Oak")], p.schema)
    a = spark.range(n).select((F.col("id") + 10).alias("address_id"), F.lit("Grand Hall").alias("building_name"), F.lit("12").alias("street_number"), F.lit("oak").alias("street_name"))
    more = spark.createDataFrame([(1, "", "5", "elm"), (2, "", "6", "elm"), (3, "", "6", "Elm"), (4, "Some Inn", "7", "elm"), (5, "Grand Halls", "12", "oak")], a.schema)
    matched, inserts = ad.resolve_address(p.unionByName(extra), a.unionByName(more), "k")
    got = {(r.k, r.address_id, r.tier) for r in matched.collect()}
    assert got == {(k, 5, 3) for k in range(n)} | {(900, 1, 3)}
    assert {r.full_address.split(",")[0] for r in inserts.collect()} == {"6 Elm", "7 elm", "Far"}
    assert most_rows(matched) < 10 * n


def test_equal_pairs_of_names_are_scored_once(spark, sf, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def seen(a, b):
        made.add(1)
        return 1.0

    load_all()
    monkeypatch.setattr(fz, "sequence_ratio", F.udf(seen, "double").asNondeterministic())
    got = registry.QUERIES["fuzzy_scores"](spark, sf).collect()
    j = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/part.parquet"), F.expr("c_custkey = p_partkey"))
    pairs = j.select("c_mktsegment", "p_name").distinct().count()
    assert len(got) == j.count() > pairs == made.value


def test_replay_by_page_where_an_id_is_repeated(spark):
    cols = "event_name string, start_date string, start_time string, source string, location string, url string"
    row = lambda name, url: (name, "2024-05-01", "19:30", "s", "Hall", url)
    base = spark.createDataFrame([(1, *row("Ball", "https://a.org/1")), (1, *row("Gala", "https://a.org/2")), (2, *row("Ball", "https://a.org/3"))], f"base_id long, {cols}")
    cand = spark.createDataFrame([(7, "https://a.org/1", *row("Ball", "https://a.org/1")), (8, "https://a.org/2", *row("Gala", "https://a.org/2"))], f"cand_id long, page_url string, {cols}")
    got = sorted((r.base_id, r.cand_id or 0, r.is_match) for r in replay.match_replay(base, cand).collect())
    assert got == [(1, 7, True), (1, 8, True), (2, 0, False)]


def test_location_texts_are_judged_once(spark, monkeypatch):
    judged, poor = spark.sparkContext.accumulator(0), ad.tx.low_quality_location

    def seen(t):
        judged.add(1)
        return False

    monkeypatch.setattr(ad.tx, "low_quality_location", lambda c: F.udf(seen, "boolean")(c) | poor(c))
    df = spark.range(300).select(F.col("id").alias("k"), F.concat(F.lit("Grand Oak Hall "), (F.col("id") % 3).cast("string")).alias("t"))
    a = spark.createDataFrame([(5, "Grand Oak Hall", "1 Main, Victoria"), (4, "Grand Oak Hall", "2 Main, Victoria"), (1, "Elm House", "3 Main, Victoria")], "address_id long, building_name string, full_address string")
    got = ad.best_building(df, a, "k", "t").collect()
    assert len(got) == 300 and {r.address_id for r in got} == {4} and judged.value < 30


def test_tags_and_dates_are_worked_out_once_per_text(spark, sf, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    tags, dates = search_plans.op.question_tags, calendar_plans.dt.candidate_dates
    monkeypatch.setattr(search_plans.op, "question_tags", lambda c: tags(F.udf(mark, "string")(c)))
    monkeypatch.setattr(calendar_plans.dt, "candidate_dates", lambda c, a: dates(F.udf(mark, "string")(c), a))
    load_all()
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert registry.QUERIES["question_tags"](spark, sf).count() == n and 0 < seen.value < n / 5
    seen.value = 0
    days = spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate")).distinct().count()
    assert registry.QUERIES["text_candidate_dates"](spark, sf).count() == n and 0 < seen.value <= days < n


def test_values_of_null_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a"), (5, "b")], "k int, v string")
    got = keyed.once_per_value(df, "v", w=F.coalesce(F.upper("v"), F.lit("none"))).select("k", "w").collect()
    assert sorted((r.k, r.w) for r in got) == [(1, "none"), (2, "A"), (3, "none"), (4, "A"), (5, "B")]


def test_page_texts_are_returned_in_stretches(spark, monkeypatch):
    pages = [(1, None), (2, ""), (3, "<p>a</p><main>b <b>c</b></main>")] + [(k, f"<script>no</script>é{k}" + "x" * 50) for k in range(4, 40)]
    df = spark.createDataFrame(pages, "page_id long, html string").coalesce(1)
    want = {r.page_id: r.body for r in df.select("page_id", html.html_to_text("html").alias("body")).collect()}
    monkeypatch.setattr(html, "TOGETHER", 200)

    out = html.with_page_text(df, "html", "body")
    assert {r.page_id: r.body for r in out.collect()} == want | {1: ""} and want[3] == "b c a b c"
    assert out.columns == ["page_id", "body"]
