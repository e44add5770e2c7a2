"""Date and weekday rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..operators import calendar as op
from ..operators.keyed import once_per_value
from ..sources.adapters import ev, table
from .common import EV, ORD
from .registry import query


def _orders(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("d")
    )


@query("parse_event_ts", """
SELECT event_id, CASE WHEN event_id%4=0 THEN NULL WHEN event_id%4=1 THEN
  strftime(date_trunc('second', ts) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S')
 ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def _(spark, d):
    k = F.col("event_id") % 4
    t = F.substring(F.col("ts").cast("string"), 1, 19)
    raw = F.when(k == 0, "2024-02-31 25:00").when(k == 1, F.concat(F.replace(t, F.lit(" "), F.lit("T")), F.lit("Z"))).otherwise(t)
    return table(spark, d, "events").select("event_id", dt.parse_event_ts(raw).cast("string").alias("parsed"))


@query("roll_overnight_end", f"""
WITH {EV} SELECT event_id, CAST(CASE WHEN end_sec<start_sec THEN start_date+1 ELSE start_date END AS VARCHAR) AS end_date FROM ev""")
def _(spark, d):
    e = ev(spark, d).withColumn("end_date", F.col("start_date"))
    return op.roll_overnight(e).select("event_id", F.col("end_date").cast("string").alias("end_date"))


@query("clean_weekday", """
SELECT event_id, CASE event_id%4 WHEN 0 THEN 'Mon' WHEN 1 THEN '' ELSE dayname(ts) END AS day_of_week FROM events""")
def _(spark, d):
    k = F.col("event_id") % 4
    name = dt.weekday_name(F.to_date("ts"))
    raw = F.when(k == 0, "Mon, Tue").when(k == 1, "Every Day").when(k == 2, F.upper(name)).otherwise(name)
    return table(spark, d, "events").select("event_id", dt.clean_weekday(raw).alias("day_of_week"))


@query("repair_weekday", f"""
WITH {ORD} SELECT o_orderkey, dayname(d) AS day_of_week FROM o WHERE o_custkey%3<>0""")
def _(spark, d):
    o = _orders(spark, d).select(
        "o_orderkey", F.col("d").alias("start_date"),
        F.when(F.col("o_custkey") % 3 == 2, F.lit(None).cast("string"))
        .otherwise(dt.weekday_name(F.date_add("d", (F.col("o_custkey") % 3).cast("int")))).alias("day_of_week"),
    )
    return op.repair_weekday(o).select("o_orderkey", "day_of_week")


@query("align_recurring_dates", f"""
WITH {EV}, k AS (SELECT *, dayname(start_date+CAST(event_id%7 AS INTEGER)) AS dow, start_sec//3600 AS h FROM ev),
g AS (SELECT *, count(*) OVER (PARTITION BY place, event_type, h, dow) AS n,
 ((isodow(start_date+CAST(event_id%7 AS INTEGER))-1)-(isodow(start_date)-1)+7)%7 AS f FROM k)
SELECT event_id, CAST(start_date + CAST(CASE WHEN n>1 OR event_id%11=0 THEN CASE WHEN f<=3 THEN f ELSE f-7 END ELSE 0 END AS INTEGER) AS VARCHAR) AS start_date FROM g""")
def _(spark, d):
    e = ev(spark, d).withColumns({
        "event_name": F.concat(F.lit("Show "), F.col("place").cast("string")),
        "start_sec": F.floor(F.col("start_sec") / 3600),
        "day_of_week": dt.weekday_name(F.date_add("start_date", (F.col("event_id") % 7).cast("int"))),
        "description": F.when(F.col("event_id") % 11 == 0, "held weekly").otherwise(""),
        "location": F.lit(""), "end_date": F.col("start_date"),
    })
    return op.align_recurring(e).select("event_id", F.col("start_date").cast("string").alias("start_date"))


@query("prewrite_dates", f"""
WITH {ORD} SELECT o_orderkey, CAST(d AS VARCHAR) AS start_date,
 CASE WHEN o_orderkey%5 IN (1,3) OR o_orderkey%5=4 THEN dayname(d) ELSE 'x' END AS day_of_week
 FROM o WHERE NOT (o_orderkey%5=2) AND NOT (o_orderkey%5=4 AND year(d)<2000)""")
def _(spark, d):
    k = F.col("o_orderkey") % 5
    none = F.lit(None).cast("date")
    o = _orders(spark, d).select(
        "o_orderkey",
        F.when((k == 0) | (k == 1), F.col("d")).otherwise(none).alias("start_date"),
        F.when(k == 3, F.col("d")).otherwise(none).alias("end_date"),
        F.when((k == 1) | (k == 3), "Tonight").when(k == 4, "").otherwise("x").alias("day_of_week"),
        F.when(k == 4, F.concat(F.lit("https://a.org/e/"), F.col("d").cast("string"), F.lit("/"))).otherwise("https://a.org").alias("url"),
    )
    return op.prewrite_dates(o).select("o_orderkey", F.col("start_date").cast("string").alias("start_date"), "day_of_week")


@query("url_compact_date", f"""
WITH {ORD} SELECT o_orderkey, CASE WHEN year(d)>=2000 THEN CAST(d AS VARCHAR) END AS found FROM o""")
def _(spark, d):
    from ..functions.urls import url_date

    tail = F.lower(F.date_format("d", "ddMMMyy"))
    url = F.when(F.year("d") >= 2000, F.concat(F.lit("https://a.org/show-"), tail, F.lit("-x"))).otherwise("https://a.org/31feb01")
    return _orders(spark, d).select("o_orderkey", url_date(url).cast("string").alias("found"))


@query("header_date_override", f"""
WITH {ORD} SELECT o_orderkey, CAST(CASE WHEN o_orderkey%3=2 THEN d-7 ELSE d END AS VARCHAR) AS start_date, dayname(d) AS day_of_week FROM o""")
def _(spark, d):
    k = F.col("o_orderkey") % 3
    name = dt.weekday_name("d")
    body = (
        F.when(k == 0, F.concat(F.lit("Gala  "), name, F.date_format("d", " d MMMM yyyy"), F.lit(" from 7 PM")))
        .when(k == 1, F.concat(F.lit("Gala "), name, F.date_format("d", ", MMMM d"), F.lit("th, "), F.date_format("d", "yyyy"), F.lit(" at 7 PM. June 5, 2026 at 8")))
        .otherwise("June 5, 2026 at 8 and June 6, 2026 at 9")
    )
    o = _orders(spark, d).select("o_orderkey", F.date_sub("d", 7).alias("start_date"), name.alias("day_of_week"), body.alias("body"))
    return op.header_date_override(o, "body").select("o_orderkey", F.col("start_date").cast("string").alias("start_date"), "day_of_week")


_YEARLESS = "make_date(2001, month(d), least(day(d), 28))"


@query("text_candidate_dates", f"""
WITH {ORD}, s AS (SELECT o_orderkey, CAST(d + INTERVAL 60 MONTH AS DATE) AS d FROM o), x AS (SELECT o_orderkey, d, {_YEARLESS} AS y FROM s),
r AS (SELECT o_orderkey, d, CASE WHEN DATE '2001-08-01'-y>90 THEN make_date(2002, month(y), day(y)) ELSE y END AS y FROM x)
SELECT o_orderkey, array_to_string(list_transform(CASE WHEN d=y THEN [d] ELSE [d, y] END, lambda v: CAST(v AS VARCHAR)), ',') AS dates,
 CASE WHEN d=y THEN 'single_event' ELSE 'unknown' END AS poster FROM r""")
def _(spark, d):
    body = F.concat(
        F.date_format("d", "EEE, MMMM d"), F.lit("th "), F.date_format("d", "yyyy"), F.lit(" and "),
        F.date_format("d", "MMM "), F.least(F.dayofmonth("d"), F.lit(28)).cast("string"), F.lit(" or Feb 31, may 99"),
    )
    o = _orders(spark, d).select("o_orderkey", F.add_months("d", 60).alias("d")).select("o_orderkey", body.alias("body"))
    dates = dt.candidate_dates("body", F.lit("2001-08-01").cast("date"))
    o = once_per_value(o, "body", dates=F.array_join(F.transform(dates, lambda x: x.cast("string")), ","), poster=dt.poster_type("body", dates))
    return o.select("o_orderkey", "dates", "poster")


@query("poster_dates", f"""
WITH {ORD}, x AS (SELECT o_orderkey, CAST(d + INTERVAL 60 MONTH AS DATE) AS d, CASE o_orderkey%3 WHEN 0 THEN CAST(d + INTERVAL 60 MONTH AS DATE) WHEN 1 THEN DATE '2001-02-03' END AS p FROM o),
y AS (SELECT *, CASE WHEN p IS NULL OR p=d THEN [d] ELSE [p, d] END AS v, CASE WHEN o_orderkey%4=0 THEN 'mon tue wed jan' ELSE '' END AS more FROM x),
z AS (SELECT *, CASE WHEN len(v)>=2 AND more<>'' THEN 'schedule_multi_event' ELSE 'single_event' END AS poster FROM y)
SELECT o_orderkey, array_to_string(list_transform(v, lambda t: CAST(t AS VARCHAR)), ',') AS dates, poster, CASE WHEN poster='single_event' THEN CAST(coalesce(p, d) AS VARCHAR) END AS primary_date FROM z""")
def _(spark, d):
    k = F.col("o_orderkey")
    o = _orders(spark, d).select(k, F.add_months("d", 60).alias("d"))
    o = o.withColumns({
        "p": F.when(k % 3 == 0, F.col("d")).when(k % 3 == 1, F.lit("2001-02-03").cast("date")),
        "body": F.concat(F.date_format("d", "MMMM d, yyyy"), F.when(k % 4 == 0, " mon tue wed jan").otherwise("")),
    })
    o = o.withColumn("v", dt.candidate_dates("body", F.lit("2001-08-01").cast("date"), F.col("p")))
    o = o.withColumn("poster", dt.poster_type("body", F.col("v"), F.col("p")))
    return o.select(
        k, F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("dates"), "poster",
        dt.poster_date(F.col("v"), F.col("poster"), F.col("p")).cast("string").alias("primary_date"),
    )


@query("expand_schedule", f"""
WITH {ORD}, r AS (SELECT o_custkey, o_orderkey, o_orderkey%4=0 AS listed, DATE '2001-01-01'+CAST(o_custkey%30 AS INTEGER) AS d1,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM o),
u AS (SELECT *, CASE WHEN NOT listed THEN row_number() OVER (PARTITION BY o_custkey, listed ORDER BY o_orderkey) END AS u,
  min(CASE WHEN listed THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS pm FROM r),
p AS (SELECT *, max(CASE WHEN u=2 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS p2 FROM u)
SELECT o_orderkey, CAST(CASE WHEN listed THEN d1+1 WHEN u=1 THEN d1 WHEN u=2 THEN CASE WHEN pm<p2 THEN d1+2 ELSE d1+1 END
  WHEN u=3 AND NOT coalesce(pm<p2, false) THEN d1+2 END AS VARCHAR) AS start_date FROM p WHERE n>1
UNION ALL SELECT o_orderkey, CAST(d1+k AS VARCHAR) FROM p, (SELECT unnest([0,1,2]) AS k) WHERE n=1""")
def _(spark, d):
    d1 = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("o_custkey") % 30).cast("int"))
    o = _orders(spark, d).select(
        "o_orderkey", "o_custkey", F.array(d1, F.date_add(d1, 1), F.date_add(d1, 2)).alias("dates"),
        F.when(F.col("o_orderkey") % 4 == 0, F.date_add(d1, 1)).alias("start_date"),
        F.lit(None).cast("date").alias("end_date"), F.lit("").alias("day_of_week"),
    )
    return op.expand_schedule(o, "o_custkey", "o_orderkey", "dates").select(
        "o_orderkey", F.col("start_date").cast("string").alias("start_date")
    )


@query("resolve_date_conflict", f"""
WITH {ORD}, x AS (SELECT o_orderkey, CASE WHEN o_orderkey%7<>0 THEN d END AS rd, d+CAST(o_custkey%10 AS INTEGER) AS fd,
  CASE o_custkey%4 WHEN 0 THEN '' WHEN 1 THEN dayname(d) WHEN 2 THEN dayname(d+1) ELSE dayname(d+CAST(o_custkey%10 AS INTEGER)) END AS dow,
  o_orderpriority='1-URGENT' AS rec FROM o),
y AS (SELECT *, dayname(fd) AS fdow FROM x),
z AS (SELECT *, 4 + CASE WHEN dow='' THEN 0 WHEN dow=dayname(rd) THEN 3 ELSE -5 END + CASE WHEN rec THEN 2 ELSE 0 END
   + CASE WHEN abs(rd-fd)<=7 THEN 1 ELSE 0 END AS es, 2 + CASE WHEN dow='' THEN 0 WHEN dow=fdow THEN 3 ELSE -5 END AS ds FROM y),
w AS (SELECT *, CASE WHEN rd IS NULL THEN 'fill_detected' WHEN rd=fd THEN 'keep_existing'
  WHEN dow<>'' AND dow=fdow AND NOT rec THEN 'drop_ambiguous' WHEN ds>=es+4 THEN 'replace_with_detected'
  WHEN es>=ds+2 THEN 'keep_existing' ELSE 'drop_ambiguous' END AS action FROM z)
SELECT o_orderkey, action, CAST(CASE WHEN action IN ('fill_detected','replace_with_detected') THEN fd
  WHEN action='keep_existing' THEN rd END AS VARCHAR) AS resolved_date FROM w""")
def _(spark, d):
    k, plus = F.col("o_custkey") % 4, (F.col("o_custkey") % 10).cast("int")
    found = F.date_add("d", plus)
    o = _orders(spark, d).select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("d")).alias("start_date"),
        found.alias("found"), dt.weekday_name(found).alias("found_day"),
        F.when(k == 0, "").when(k == 1, dt.weekday_name("d")).when(k == 2, dt.weekday_name(F.date_add("d", 1)))
        .otherwise(dt.weekday_name(found)).alias("day_of_week"),
        F.lit("Show").alias("event_name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "every month").otherwise("").alias("description"),
    )
    return op.resolve_date_conflict(o, "found", "found_day").select(
        "o_orderkey", "action", F.col("resolved_date").cast("string").alias("resolved_date")
    )


@query("times_equal_12h", """
SELECT event_id, strftime(ts, '%H:%M:00') AS norm, event_id%3<>2 AS same FROM events""")
def _(spark, d):
    k = F.col("event_id") % 3
    e = table(spark, d, "events").select(
        "event_id", F.date_format(F.col("ts").cast("timestamp_ntz"), "hh:mm a").alias("a"),
        F.when(k == 0, F.date_format("ts", "HH:mm")).when(k == 1, F.date_format(F.col("ts") + F.expr("interval 12 hours"), "HH:mm"))
        .otherwise(F.date_format(F.col("ts") + F.expr("interval 1 hour"), "HH:mm")).alias("b"),
    )
    a, b = dt.time_norm("a"), dt.time_norm("b")
    return e.select("event_id", a.alias("norm"), dt.times_equal_12h(a, b).alias("same"))


@query("expand_recurring", """
WITH n AS (SELECT n_nationkey, CAST((n_nationkey%7 - (isodow(DATE '2024-01-31')-1) + 7)%7 AS INTEGER) AS ahead FROM nation),
f AS (SELECT n_nationkey, DATE '2024-01-31' + CASE WHEN ahead=0 AND n_nationkey%2=1 THEN 7 ELSE ahead END AS f FROM n)
SELECT n_nationkey, CAST(f+CAST(7*w AS INTEGER) AS VARCHAR) AS start_date FROM f, (SELECT unnest(range(0, 4)) AS w)""")
def _(spark, d):
    names = F.array(*[F.lit(w) for w in dt.WEEKDAYS])
    rules = table(spark, d, "nation").select(
        "n_nationkey", F.get(names, F.col("n_nationkey") % 7).alias("weekday"), (F.col("n_nationkey") % 2 == 0).alias("include_today")
    )
    out = op.expand_recurring(rules, F.lit("2024-01-31").cast("date"), weeks=4)
    return out.select("n_nationkey", F.col("start_date").cast("string").alias("start_date"))
