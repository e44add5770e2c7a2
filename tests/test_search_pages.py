import datetime as dtm

from pyspark.sql import functions as F

from curatrix.functions.html import html_to_text
from curatrix.operators import pages
from curatrix.operators import search


def calendar(spark, anchor):
    df = spark.createDataFrame([(dtm.date.fromisoformat(anchor),)], "anchor date")
    return {r.phrase: (str(r.start_date), str(r.end_date)) for r in search.phrase_calendar(df).collect()}


def test_phrase_ranges(spark):
    c = calendar(spark, "2026-02-18")  # a Wednesday
    assert c["this week"] == ("2026-02-18", "2026-02-21")
    assert c["next week"] == ("2026-02-22", "2026-02-28")
    assert c["this weekend"] == ("2026-02-20", "2026-02-22")
    assert c["next weekend"] == ("2026-02-27", "2026-03-01")
    assert c["last wednesday"] == ("2026-02-11", "2026-02-11")
    assert c["wednesday"] == ("2026-02-18", "2026-02-18")
    assert c["next month"] == ("2026-03-01", "2026-03-31")
    assert c["before next week"] == ("1900-01-01", "2026-02-21")
    assert c["after this weekend"] == ("2026-02-23", "2027-02-22")


def test_question_ranges(spark):
    asked = [
        ("Next Wednesday. That would be March 18, 2026.", "2026-03-09", "march 18, 2026", "2026-03-18", "2026-03-18"),
        ("next wednesday", "2026-03-09", "next wednesday", "2026-03-18", "2026-03-18"),
        ("18 march 2026", "2026-03-09", "18 march 2026", "2026-03-18", "2026-03-18"),
        ("Where can I dance the first week of April?", "2026-03-09", "the first week of april", "2026-04-01", "2026-04-07"),
        ("first week of next month", "2026-12-09", "first week of next month", "2027-01-01", "2027-01-07"),
        ("between march 3, 2026 and march 9, 2026", "2026-03-01", "between march 3, 2026 and march 9, 2026", "2026-03-03", "2026-03-09"),
        ("between next friday and today", "2026-03-09", "between next friday and today", "2026-03-09", "2026-03-20"),
        ("What social dances are happening in the upcoming week?", "2026-03-09", "upcoming week", "2026-03-09", "2026-03-15"),
        ("Show me upcoming 30 days of dance events.", "2026-03-09", "upcoming 30 days", "2026-03-09", "2026-04-07"),
        ("upcoming events", "2026-03-09", "upcoming events", "2026-03-09", "2026-04-07"),
        ("salsa in september", "2026-03-09", "september", "2026-09-01", "2026-09-30"),
        ("on 3/18", "2026-03-09", "3/18", "2026-03-18", "2026-03-18"), ("on 13/45", "2026-03-09", "13/45", None, None),
        ("second week of feb 2024", None, "second week of feb 2024", "2024-02-08", "2024-02-14"),
        ("no time at all", "2026-03-09", None, None, None), (None, "2026-03-09", None, None, None), ("", None, None, None, None),
    ]
    df = spark.createDataFrame([(k, a[0], a[1], "x") for k, a in enumerate(asked)], "k int, q string, day string, phrase_of string")
    got = {r.k: (r.phrase, *(None if d is None else str(d) for d in (r.start_date, r.end_date))) for r in search.question_ranges(df, "q", "day").collect()}
    assert got == {k: a[2:] for k, a in enumerate(asked)}
    day = F.lit("2026-03-09").cast("date")
    r = spark.range(1).select(search.dated_range(F.lit("before march 18, 2026"), day).alias("b"), search.dated_range(F.lit("after april"), day).alias("a"), search.dated_range(F.lit("soon"), day).alias("n")).first()
    assert (str(r.b.start_date), str(r.b.end_date)) == ("1900-01-01", "2026-03-17")
    assert (str(r.a.start_date), str(r.a.end_date)) == ("2026-05-01", "2027-04-30") and r.n is None


def test_question_tags(spark):
    q = [("Salsa or bachata classes, no tango, on Tuesdays, top 5",), ("not just salsa",), ("workshop without social dances",)]
    t = spark.createDataFrame(q, "q string").select(search.question_tags("q").alias("t")).select("t.*").collect()
    assert t[0].include_styles == ["salsa", "bachata"] and "tango" in t[0].exclude_styles
    assert t[0].weekdays == [1] and t[0].limit == 5 and t[0].include_types == ["class"]
    assert t[1].include_styles == []
    assert t[2].exclude_types == ["social dance"]
    phrase = spark.createDataFrame([("what is on before next friday?",)], "q string").select(search.question_phrase("q")).first()[0]
    assert phrase == "before next friday"


def test_search_limits_and_terms(spark):
    d = dtm.date(2026, 3, 6)
    ev = spark.createDataFrame([(i, d, i * 100, "class", "salsa", "Wicket Halls", "s", "u") for i in range(5)] + [(9, d, 1, "class", None, "x", "s", "u")],
                               "event_id long, start_date date, start_sec int, event_type string, dance_style string, location string, source string, url string")
    cons = spark.createDataFrame(
        [(1, d, d, None, None, None, ["salsa"], [], [], [], ["wicket hall"], 2), (2, None, None, None, None, [5], [], [], [], [], [], None), (3, None, None, None, None, [4], [], ["tango"], [], [], [], None)],
        "query_id long, start_date date, end_date date, time_from int, time_to int, weekdays array<int>, include_styles array<string>, exclude_styles array<string>, include_types array<string>, exclude_types array<string>, locations array<string>, `limit` int")
    got = sorted((r.query_id, r.event_id) for r in search.search_events(ev, cons).collect())
    assert got == [(1, 0), (1, 1)] + [(3, i) for i in range(5)]


def test_visible_text_and_rules(spark):
    html = "<html><head><script>x</script></head><body><p>Intro</p><main>Main <b>act</b></main><!-- no --></body></html>"
    df = spark.createDataFrame([("https://a.org/event/1", html)], "url string, html string")
    assert df.select(html_to_text("html")).first()[0] == "Main act Intro Main act"
    f = pages.html_features(df).first()
    assert f.schema_event_count == 0 and not f.single_event_signal
    rule = df.select(pages.classify_rules("url", F.lit(""), F.lit(0)).alias("r")).first().r
    assert (rule.archetype, rule.owner_step, rule.subtype) == ("simple_page", "scraper.py", "event_detail")


def test_schema_and_cards(spark):
    html = '<script type="application/ld+json">{"@type": "MusicEvent", "x": {"@type": ["Event"]}}</script><div class="event-card">a</div><div class="event-card">b</div><a href="/tickets">t</a> Friday 7:30 pm, June 5, 12 Oak St'
    f = pages.html_features(spark.createDataFrame([("u", html)], "url string, html string")).first()
    assert (f.schema_event_count, f.listing_card_count, f.ticket_link_count) == (2, 2, 1)
    assert (f.time_count, f.date_count, f.address_count) == (1, 2, 1)


def test_excluded_terms_are_not_included(spark):
    q = spark.createDataFrame([("workshops without kizomba or kizomba lessons",)], "q string").select(search.question_tags("q").alias("t")).first().t
    assert "kizomba" in q.exclude_styles and "kizomba" not in q.include_styles
