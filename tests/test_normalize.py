import datetime as dtm

from pyspark.sql import functions as F

from curatrix.functions import dates as dt
from curatrix.functions import text as tx
from curatrix.functions import urls as u
from curatrix.operators import calendar as cal
from curatrix.operators import normalize as norm


def one(spark, expr, value="x"):
    return spark.createDataFrame([(value,)], "c string").select(expr.alias("r")).first()[0]


def test_url_keys(spark):
    k = F.col("c")
    assert one(spark, u.url_compare_key(k), "HTTP://A.org:80/x/?q=1#f") == "http://a.org/x?q=1"
    assert one(spark, u.url_compare_key(k), "https://a.org:443/") == "https://a.org"
    assert one(spark, u.url_identity(k), "HTTPS://A.org:8443/X/?q=1") == "https://a.org/x"
    assert one(spark, u.url_eval_key(k), "Desk@Mail.ORG") == "desk@mail.org"
    assert one(spark, u.source_from_url(k), "https://www.foo.bar.ca/x") == "bar"
    got = one(spark, u.strip_cdn_params(k), "https://scontent.cdninstagram.com/p.jpg?a=1&oh=2&oe=3&b=4")
    assert got == "https://scontent.cdninstagram.com/p.jpg?a=1&b=4"
    assert one(spark, u.strip_cdn_params(k), "https://a.org/p?oh=2") == "https://a.org/p?oh=2"
    assert one(spark, u.url_template_key(k, u.PLATFORM_FAMILIES), "https://www.facebook.com/club/posts/123") == "https://www.facebook.com/club/posts"
    assert one(spark, u.unwrap_next(k, "facebook.com"), "https://www.facebook.com/login/?next=%2Fevents%2F5") == "https://www.facebook.com/events/5"


def test_text_rules(spark):
    k = F.col("c")
    assert one(spark, tx.binary_label(k), "Label 10: 1") == 1
    assert one(spark, tx.binary_label(k), "none") is None
    assert one(spark, tx.binary_label(k, "strict"), "-1") == 0
    assert one(spark, tx.binary_label(k, "strict"), "2") is None
    assert one(spark, norm.canadian_postal_code(k), "at v8n1s3 now") == "V8N 1S3"
    assert one(spark, tx.specific_terms(F.split(k, ","), ("a", "b", "c", "d", "e")), "a,b,c,d,e") == ""
    assert one(spark, tx.specific_terms(F.split(k, ","), ("a", "b")), "b, z,A,b") == "b, a"


def test_dates(spark):
    k = F.col("c")
    as_of = F.lit("2026-03-10").cast("date")
    got = one(spark, dt.candidate_dates(k, as_of), "Fri, March 13 and Jan 2, 2027; Nov 1st; Jan 5, March 13")
    assert got == [dtm.date(2026, 3, 13), dtm.date(2027, 1, 2), dtm.date(2026, 11, 1), dtm.date(2026, 1, 5)]
    assert one(spark, dt.time_norm(k), "7:30 pm") == "19:30:00"
    assert one(spark, dt.time_norm(k), "12:05 AM") == "00:05:00"
    assert one(spark, dt.header_date(k), "Gala Friday 5 June 2026 from 7") == dtm.date(2026, 6, 5)
    assert one(spark, dt.header_date(k), "June 5, 2026 at 7, June 6, 2026 at 8") is None
    assert str(one(spark, dt.parse_event_ts(k), "2026-01-02T03:00:00Z")) == "2026-01-01 19:00:00"
    assert one(spark, dt.parse_event_ts(k), "soon") is None
    assert one(spark, u.url_date(k), "https://a.org/x-07mar24.html") == dtm.date(2024, 3, 7)


def test_recurring_rows_move_to_stated_weekday(spark):
    d = dtm.date(2026, 4, 7)  # a Tuesday
    rows = [("Swing", "", "", "Monday", d, d, 100, "s"), ("Swing", "", "", "Monday", dtm.date(2026, 4, 14), None, 100, "s"), ("Once", "", "", "Monday", d, d, 100, "s")]
    df = spark.createDataFrame(rows, "event_name string, description string, location string, day_of_week string, start_date date, end_date date, start_sec int, source string")
    got = {(r.event_name, r.start_date) for r in cal.align_recurring(df).collect()}
    assert got == {("Swing", dtm.date(2026, 4, 6)), ("Swing", dtm.date(2026, 4, 13)), ("Once", d)}


def test_overnight_and_weekday(spark):
    d = dtm.date(2026, 4, 7)
    df = spark.createDataFrame([(1, d, None, 80000, 3600, "Mon"), (2, d, d, 10, 20, "tuesday")], "event_id long, start_date date, end_date date, start_sec int, end_sec int, day_of_week string")
    r = {x.event_id: x.end_date for x in cal.roll_overnight(df).collect()}
    assert r == {1: dtm.date(2026, 4, 8), 2: d}
    fixed = cal.repair_weekday(df).collect()
    assert [(x.event_id, x.day_of_week) for x in fixed] == [(1, "Tuesday")]


def test_schedule_uses_dates_in_order(spark):
    ds = [dtm.date(2026, 5, i) for i in (1, 2, 3)]
    rows = [("p", 1, None), ("p", 2, ds[1]), ("p", 3, None), ("p", 4, None), ("q", 1, None)]
    df = spark.createDataFrame([(p, n, s, None, "", ds) for p, n, s in rows], "poster string, pos long, start_date date, end_date date, day_of_week string, dates array<date>")
    got = sorted((r.poster, r.pos, r.start_date) for r in cal.expand_schedule(df, "poster", "pos", "dates").filter("start_date is not null").collect())
    assert got == [("p", 1, ds[0]), ("p", 2, ds[1]), ("p", 3, ds[2]), ("q", 1, ds[0]), ("q", 1, ds[1]), ("q", 1, ds[2])]


def test_links_join_with_their_page(spark):
    from urllib.parse import urljoin

    page = "http://h.org/a/b/c.html?q=1#f"
    links = ["events.html", "?page=2", "../x", "../../../y/./z", "/r/../s", "//o.org/p", "https://t.org", "#top", "", "./", "..", "d/e?x=../y", "mailto:a@b.c", "HTTP://U.org/"]
    html = "".join(f"<a class=k href={q}{h}{q}>t</a>" if h or q else "" for h in links for q in ("'",)) + '<A HREF=plain.html>p</A><a data-href="no" id="x">n</a>'
    df = spark.createDataFrame([(1, page, html)], "page_id long, url string, html string")
    want = [u for u in dict.fromkeys(urljoin(page, h) for h in [*links, "plain.html"]) if u.lower().startswith("http")]
    got = [r.link for r in norm.page_links(df, "page_id").orderBy("pos").collect()]
    assert [g.lower() for g in got] == [w.lower() for w in want]
