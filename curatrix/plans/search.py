"""Searches over the benchmark data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..operators import search as op
from ..operators.keyed import once_per_value
from ..sources.adapters import ev, table, wide
from .common import EV
from .registry import query

_DAYS = ", ".join(f"('{w.lower()}', {i})" for i, w in enumerate(dt.WEEKDAYS))
_CAL = f"""an AS (SELECT DISTINCT CAST(ts AS DATE) AS a FROM events), w AS (SELECT a, CAST(isodow(a)-1 AS INTEGER) AS d, a-CAST(isodow(a)%7 AS INTEGER) AS su, a-CAST(isodow(a)-1 AS INTEGER) AS mo,
  a+CAST((4-(isodow(a)-1)+7)%7 AS INTEGER) AS fr, CAST(date_trunc('month', a) AS DATE) AS m1, CAST(date_trunc('year', a) AS DATE) AS y1 FROM an),
 base AS (
  SELECT a, 'today' AS phrase, a AS s, a AS e, NULL AS t0, NULL AS t1 FROM w UNION ALL SELECT a, 'tonight', a, a, 64800, NULL FROM w UNION ALL SELECT a, 'tomorrow', a+1, a+1, NULL, NULL FROM w
  UNION ALL SELECT a, 'tomorrow night', a+1, a+1, 64800, NULL FROM w UNION ALL SELECT a, 'yesterday', a-1, a-1, NULL, NULL FROM w UNION ALL SELECT a, 'this week', a, su+6, NULL, NULL FROM w
  UNION ALL SELECT a, 'next week', su+7, su+13, NULL, NULL FROM w UNION ALL SELECT a, p, fr, fr+2, 64800, 86399 FROM w, (VALUES ('this weekend'), ('coming weekend')) v(p)
  UNION ALL SELECT a, 'next weekend', mo+11, mo+13, NULL, NULL FROM w
  UNION ALL SELECT a, p, CAST(m1+to_months(k) AS DATE), last_day(CAST(m1+to_months(k) AS DATE)), NULL, NULL FROM w, (VALUES ('this month', 0), ('next month', 1), ('last month', -1)) v(p, k)
  UNION ALL SELECT a, p, CAST(y1+to_months(12*k) AS DATE), CAST(y1+to_months(12*k+12) AS DATE)-1, NULL, NULL FROM w, (VALUES ('this year', 0), ('next year', 1), ('last year', -1)) v(p, k)
  UNION ALL SELECT a, n, a+(i-d+7)%7, a+(i-d+7)%7, NULL, NULL FROM w, dn UNION ALL SELECT a, 'this '||n, a+(i-d+7)%7, a+(i-d+7)%7, NULL, NULL FROM w, dn
  UNION ALL SELECT a, 'next '||n, mo+7+i, mo+7+i, NULL, NULL FROM w, dn
  UNION ALL SELECT a, 'last '||n, a-CASE WHEN d=i THEN 7 ELSE (d-i+7)%7 END, a-CASE WHEN d=i THEN 7 ELSE (d-i+7)%7 END, NULL, NULL FROM w, dn
  UNION ALL SELECT a, n||' '||p, a+(i-d+7)%7, a+(i-d+7)%7, t0, t1 FROM w, dn, (VALUES ('morning', 21600, 43200), ('afternoon', 43200, 61200), ('evening', 61200, 75600), ('night', 64800, NULL)) v(p, t0, t1)),
 cal AS (SELECT * FROM base UNION ALL SELECT a, 'before '||phrase, DATE '1900-01-01', s-1, NULL, NULL FROM base UNION ALL SELECT a, 'after '||phrase, e+1, e+365, NULL, NULL FROM base
  UNION ALL SELECT a, p, a, a+k, NULL, NULL FROM w, (VALUES ('upcoming week', 6), ('upcoming 30 days', 29), ('upcoming events', 29)) v(p, k))"""
_DN = f"dn AS (SELECT * FROM (VALUES {_DAYS}) v(n, i))"


@query("phrase_calendar", f"""
WITH {_DN}, {_CAL} SELECT CAST(a AS VARCHAR) AS anchor, phrase, CAST(s AS VARCHAR) AS start_date, CAST(e AS VARCHAR) AS end_date, coalesce(t0, -1) AS time_from, coalesce(t1, -1) AS time_to FROM cal""")
def _(spark, d):
    anchors = table(spark, d, "events").select(F.to_date("ts").alias("anchor"))
    c = op.phrase_calendar(anchors)
    return c.select(
        F.col("anchor").cast("string").alias("anchor"), "phrase", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
        F.coalesce("time_from", F.lit(-1)).alias("time_from"), F.coalesce("time_to", F.lit(-1)).alias("time_to"),
    )


#: Questions ({day} is the anchor date), by remainder of the event id; the SQL beside gives phrase, first and last day.
_ASKED = (
    ("Any salsa NEXT friday?", "'next friday', NULL, NULL"),
    ("what was on before this month", "'before this month', NULL, NULL"),
    ("live band, saturday night!", "'saturday night', NULL, NULL"),
    ("swing tomorrow night or so", "'tomorrow night', NULL, NULL"),
    ("hello", "NULL, NULL, NULL"),
    ("Next Wednesday. That would be March  18, 2026.", "'march 18, 2026', DATE '2026-03-18', DATE '2026-03-18'"),
    ("tango on 5 Sept?", "'5 sept', make_date(year(a), 9, 5), make_date(year(a), 9, 5)"),
    ("Where can I dance the first week of next month?", "'the first week of next month', CAST(date_trunc('month', a)+to_months(1) AS DATE), CAST(date_trunc('month', a)+to_months(1) AS DATE)+6"),
    ("the 5th week in february 2024", "'the 5th week in february 2024', DATE '2024-02-29', DATE '2024-02-29'"),
    ("fifth week of february 2023", "'fifth week of february 2023', NULL, NULL"),
    ("events in Dec 2025!", "'dec 2025', DATE '2025-12-01', DATE '2025-12-31'"),
    ("from {day} to tomorrow", "'from '||CAST(a AS VARCHAR)||' to tomorrow', a, a+1"),
    ("between march 9, 2026 and march 3, 2026", "'between march 9, 2026 and march 3, 2026', DATE '2026-03-03', DATE '2026-03-09'"),
    ("april 1 to April 7 in town", "'april 1 to april 7', make_date(year(a), 4, 1), make_date(year(a), 4, 7)"),
    ("2/30 or never", "'2/30', NULL, NULL"),
    ("between friends and family", "'between friends and family', NULL, NULL"),
)


@query("question_time_ranges", f"""
WITH {_DN}, {_CAL}, x AS (SELECT event_id, CAST(ts AS DATE) AS a, event_id%{len(_ASKED)} AS k FROM events),
q AS (SELECT event_id, a, k, r.p, r.s, r.e FROM (SELECT *, CASE k {' '.join(f"WHEN {i} THEN row({sql})" for i, (_, sql) in enumerate(_ASKED))} END AS r0 FROM x) y, LATERAL (SELECT struct_extract(r0, 1) AS p, struct_extract(r0, 2) AS s, struct_extract(r0, 3) AS e) r)
SELECT event_id, q.p AS phrase, CAST(coalesce(q.s, cal.s) AS VARCHAR) AS start_date, CAST(coalesce(q.e, cal.e) AS VARCHAR) AS end_date, coalesce(t0, -1) AS time_from, coalesce(t1, -1) AS time_to FROM q LEFT JOIN cal ON cal.a=q.a AND cal.phrase=q.p AND q.k<4""")
def _(spark, d):
    k = F.col("event_id") % len(_ASKED)
    text = F.lit(None).cast("string")
    for i, (asked, _) in enumerate(_ASKED):
        text = F.when(k == i, F.replace(F.lit(asked), F.lit("{day}"), F.to_date("ts").cast("string"))).otherwise(text)
    q = wide(spark, d, "events").select("event_id", F.to_date("ts").alias("anchor"), text.alias("q"))
    out = op.question_ranges(q, "q", "anchor")
    return out.select(
        "event_id", "phrase", *[F.col(c).cast("string").alias(c) for c in ("start_date", "end_date")],
        F.coalesce("time_from", F.lit(-1)).alias("time_from"), F.coalesce("time_to", F.lit(-1)).alias("time_to"),
    )


_STY = list(op.STYLE_SYNONYMS.items())
_NEG = r"\b(?:not\s+(?:just|only)?\s*|no\s+|without\s+|exclud(?:e|ing)\s+|except\s+)"
_EXC = r"\b(?:not\s+|no\s+|without\s+|exclud(?:e|ing)\s+|except\s+)"


def _any(words):
    return r"\b(?:" + "|".join(words) + r")\b"


_INC_SQL = "[" + ", ".join(f"CASE WHEN regexp_matches(regexp_replace(q, '{_NEG}{_any(ws)}', '', 'g'), '{_any(ws)}') THEN '{s}' END" for s, ws in _STY) + "]"
_EXC_SQL = "[" + ", ".join(f"CASE WHEN regexp_matches(q, '{_EXC}{_any(ws)}') THEN '{s}' END" for s, ws in _STY) + "]"
_TYP_SQL = "[" + ", ".join(f"CASE WHEN regexp_matches(q, '{_any(ws)}') THEN '{t}' END" for t, ws in op.TYPE_WORDS.items()) + "]"
_QTEXT = """(CASE o_orderkey%6 WHEN 0 THEN 'show me '||CAST(o_custkey%40+1 AS VARCHAR)||' salsa classes but no bachata' WHEN 1 THEN 'wcs social dances on tuesdays near '||lower(o_orderpriority)
 WHEN 2 THEN 'live bands every friday, not tango' WHEN 3 THEN 'all styles, top '||CAST(o_custkey%9+1 AS VARCHAR) WHEN 4 THEN 'workshops without kizomba or kizomba lessons' ELSE 'lindy hop or zouk '||lower(o_orderstatus) END)"""


@query("question_tags", f"""
WITH x AS (SELECT o_orderkey, {_QTEXT} AS q FROM orders)
SELECT o_orderkey, CASE WHEN contains(q, 'all styles') THEN '' ELSE array_to_string(list_filter({_INC_SQL}, lambda v: v IS NOT NULL AND NOT list_contains(list_filter({_EXC_SQL}, lambda z: z IS NOT NULL), v)), '|') END AS include_styles,
 array_to_string(list_filter({_EXC_SQL}, lambda v: v IS NOT NULL), '|') AS exclude_styles, array_to_string(list_filter({_TYP_SQL}, lambda v: v IS NOT NULL), '|') AS include_types,
 CASE o_orderkey%6 WHEN 1 THEN '1' WHEN 2 THEN '4' ELSE '' END AS weekdays, coalesce(TRY_CAST(regexp_extract(q, '(?:show me|top) (\\d+)', 1) AS INTEGER), -1) AS "limit" FROM x""")
def _(spark, d):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    q = (
        F.when(k == 0, F.concat(F.lit("Show me "), (c % 40 + 1).cast("string"), F.lit(" salsa classes but no bachata")))
        .when(k == 1, F.concat(F.lit("WCS social dances on Tuesdays near "), "o_orderpriority")).when(k == 2, "live bands every friday, not tango")
        .when(k == 3, F.concat(F.lit("all styles, top "), (c % 9 + 1).cast("string"))).when(k == 4, "workshops without kizomba or kizomba lessons")
        .otherwise(F.concat(F.lit("lindy hop or zouk "), "o_orderstatus"))
    )
    t = once_per_value(table(spark, d, "orders").select("o_orderkey", q.alias("q")), "q", t=op.question_tags("q"))
    return t.select(
        "o_orderkey", *[F.array_join(f"t.{x}", "|").alias(x) for x in ("include_styles", "exclude_styles", "include_types")],
        F.array_join(F.transform("t.weekdays", lambda v: v.cast("string")), "|").alias("weekdays"), F.coalesce("t.limit", F.lit(-1)).alias("limit"),
    )


@query("search_events", f"""
WITH {EV}, q AS (SELECT n_nationkey AS qid, CASE WHEN n_nationkey%4<>0 THEN DATE '2024-01-01'+n_nationkey END AS s, CASE WHEN n_nationkey%5<>0 THEN DATE '2024-01-08'+n_nationkey END AS e,
  CASE WHEN n_nationkey%3=0 THEN 64800 END AS t0, n_nationkey%7 AS wd, n_nationkey%2=0 AS anyday, 5+n_nationkey AS lim FROM nation)
SELECT qid AS query_id, event_id FROM q JOIN ev ON start_date>=coalesce(s, DATE '1900-01-01') AND start_date<=coalesce(e, DATE '2100-01-01') AND (t0 IS NULL OR start_sec>=t0) AND (anyday OR isodow(start_date)-1=wd)
 AND (contains(event_type, 'i') OR event_type='purchase') AND NOT contains(event_type, 'view') AND (contains('hall '||CAST(place AS VARCHAR), 'hall 1') OR contains(event_type, 'click'))
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY start_date, start_sec, event_id)<=any_value(lim) OVER (PARTITION BY qid)""")
def _(spark, d):
    n = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    cons = table(spark, d, "nation").select(
        n.alias("query_id"), F.when(n % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), n)).alias("start_date"), F.when(n % 5 != 0, F.date_add(F.lit("2024-01-08").cast("date"), n)).alias("end_date"),
        F.when(n % 3 == 0, 64800).alias("time_from"), F.lit(None).cast("int").alias("time_to"), F.when(n % 2 != 0, F.array((n % 7).cast("int"))).alias("weekdays"),
        none.alias("include_styles"), none.alias("exclude_styles"), F.array(F.lit("I"), F.lit("Purchase")).alias("include_types"), F.array(F.lit("view")).alias("exclude_types"),
        F.array(F.lit("Hall 1"), F.lit("click")).alias("locations"), (n + 5).alias("limit"),
    )
    e = ev(spark, d).select(
        "event_id", "start_date", "start_sec", "event_type", F.lit("salsa").alias("dance_style"), F.concat(F.lit("hall "), F.col("place").cast("string")).alias("location"), "source", F.lit("").alias("url"),
    )
    return op.search_events(e, cons).select("query_id", "event_id")


@query("question_grid", """
SELECT r_name AS category, 'Show me '||t||' in '||lower(n_name) AS question FROM region JOIN nation ON n_regionkey=r_regionkey, (VALUES ('classes'), ('workshops'), ('social dances')) v(t)""")
def _(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    places = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.lower("n_name"))).alias("p2_values"))
    t = r.join(places, r["r_regionkey"] == places["n_regionkey"]).select(
        F.col("r_name").alias("category"), F.lit("Show me {event_type} in {place}").alias("template"), F.lit("event_type").alias("p1_name"),
        F.array(F.lit("classes"), F.lit("workshops"), F.lit("social dances")).alias("p1_values"), F.lit("place").alias("p2_name"), "p2_values",
    )
    return op.question_grid(t).select("category", "question")
