"""Filters and quality gates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u
from ..operators import gates as op
from ..operators import rules
from ..sources.adapters import customer_address, ev, table, wide
from .common import ADDR, EV, ORD, compare_key, netloc, path, qry
from .registry import query

AS_OF = "2001-08-01"


def _as_of(day=AS_OF):
    return F.lit(day).cast("date")


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("d", F.to_date("o_orderdate"))


_GATE = """g AS (SELECT doc_id, source, CASE
  WHEN doc_id%10=0 OR (doc_id%10=1) THEN 'insufficient_event_data'
  WHEN contains(b, 'ation') OR (regexp_matches(b, '\\b(?:pl|pt)\\b') AND regexp_matches(b, '\\b(?:country|conference|festival)\\b')) THEN 'out_of_scope_location'
  WHEN source='src1' AND NOT (contains(b, 'the ') OR regexp_matches(b, '\\b(?:bc|b\\.c\\.)\\b')) THEN 'social_image_missing_locality'
  ELSE 'kept' END AS reason FROM (SELECT doc_id, source, ' show '||lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))||' '||source||' ' AS b FROM documents))"""


def _gated(spark, d):
    k = F.col("doc_id") % 10
    docs = wide(spark, d, "documents").select(
        "doc_id", "source",
        F.when(k == 0, " Unknown ").otherwise("Show").alias("event_name"),
        F.when(k == 1, "nan").otherwise("2024-01-01").alias("start_date"),
        F.lit("x").alias("location"), F.col("text").alias("description"),
        F.lit("").alias("start_time"), F.lit("").alias("end_time"),
    )
    reason = op.quality_reason(
        ("event_name", "description", "source"), social=F.col("source") == "src1",
        nonlocal_markers=("ation",), local_markers=("the ",),
    )
    return docs.withColumn("reject_reason", reason)


@query("write_quality_gate", f"WITH {_GATE} SELECT doc_id, reason FROM g")
def _(spark, d):
    return _gated(spark, d).select("doc_id", F.coalesce("reject_reason", F.lit("kept")).alias("reason"))


@query("dominant_reject_reason", f"""
WITH {_GATE}, c AS (SELECT source, reason, count(*) AS n FROM g WHERE reason<>'kept' GROUP BY ALL)
SELECT source, reason AS reject_reason, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, reason)=1""")
def _(spark, d):
    _, rejected = op.split_by_reason(_gated(spark, d))
    return op.dominant_reason(rejected, ["source"])


@query("drop_us_addresses", "SELECT c_custkey FROM customer WHERE c_custkey%4 NOT IN (0, 2) AND NOT (c_custkey%4=3 AND c_nationkey%2=0)")
def _(spark, d):
    k = F.col("c_custkey") % 4
    c = table(spark, d, "customer").select(
        "c_custkey",
        F.when(k == 0, F.concat(F.col("c_name"), F.lit(", Seattle, WA  98101"))).when(k == 1, "12345 Long Rd, Victoria BC")
        .when(k == 2, "Main, United States 12345-6789").otherwise("Hall").alias("location"),
        F.lit("98101").alias("postal_code"), F.lit("").alias("province_or_state"),
        F.when(F.col("c_nationkey") % 2 == 0, "usa").otherwise("ca").alias("country_id"),
    )
    us = op.is_us_address("location", F.when(k == 3, F.col("postal_code")), "province_or_state", "country_id")
    return c.filter(~us).select("c_custkey")


@query("drop_old", f"""
WITH {ORD}, x AS (SELECT o_orderkey, CASE WHEN o_orderkey%9<>0 THEN d END AS d FROM o)
SELECT o_orderkey, d IS NOT NULL AS kept_on_write FROM x WHERE d IS NULL OR d >= DATE '{AS_OF}'-365""")
def _(spark, d):
    o = _orders(spark, d).select(
        "o_orderkey", F.lit(None).cast("date").alias("end_date"), F.when(F.col("o_orderkey") % 9 != 0, F.col("d")).alias("start_date")
    )
    return o.filter(~op.is_old(_as_of(), 365, "keep")).select(
        "o_orderkey", (~op.is_old(_as_of(), 365, "drop")).alias("kept_on_write")
    )


@query("drop_all_empty", "SELECT event_id FROM events WHERE NOT (event_id%6=0 AND event_type='view')")
def _(spark, d):
    gone = (F.col("event_id") % 6 == 0) & (F.col("event_type") == "view")
    e = table(spark, d, "events").select(
        "event_id", F.when(~gone, F.col("event_type")).otherwise("  ").alias("location"),
        F.when(~gone, F.col("value").cast("string")).alias("start_time"), F.lit("").alias("description"),
    )
    return e.filter(~op.all_empty(["location", "start_time", "description"])).select("event_id")


@query("enforce_event_url", f"""
WITH x AS (SELECT page_id, CASE WHEN page_id%4=0 THEN '' ELSE url END AS raw, page_id%3=0 AS has_default FROM pages),
y AS (SELECT *, CASE WHEN raw='' OR contains({netloc('raw')}, 'example.org') THEN '' ELSE raw END AS row FROM x)
SELECT page_id, CASE WHEN row<>'' THEN row WHEN has_default THEN 'https://base.net/all' ELSE 'https://parent.net' END AS url,
 row<>'' AS needs_check FROM y""")
def _(spark, d):
    p = wide(spark, d, "pages").select(
        "page_id", F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("url")).alias("url"), F.lit("Some Hall").alias("source"),
        F.when(F.col("page_id") % 3 == 0, "https://base.net/all").otherwise("ftp://x").alias("batch_url"),
    )
    out = op.enforce_event_url(p, F.col("batch_url"), F.lit("https://parent.net"), F.lit("Some Hall"), ("example.org",))
    return out.filter("keep").select("page_id", "url", "needs_check")


@query("not_blacklisted", "SELECT page_id FROM pages WHERE NOT contains(lower(url), 'example.org') AND NOT contains(lower(url), '/africa')")
def _(spark, d):
    listed = table(spark, d, "region").select(
        F.when(F.col("r_regionkey") == 0, "Example.org ").otherwise(F.concat(F.lit("/"), F.lower("r_name"))).alias("domain")
    )
    return rules.anti_contains(wide(spark, d, "pages"), listed).select("page_id")


@query("is_whitelisted", f"""
WITH k AS (SELECT page_id, {compare_key('url')} AS key FROM pages), r AS (SELECT key FROM k WHERE page_id%10=0),
rp AS (SELECT DISTINCT regexp_replace(key, '[?].*$', '') AS root FROM r)
SELECT page_id FROM k WHERE EXISTS (SELECT 1 FROM rp WHERE {netloc('key')}={netloc('root')}
 AND regexp_extract(key,'^([a-z]+):',1)=regexp_extract(root,'^([a-z]+):',1) AND starts_with({path('key')}, {path('root')}))""")
def _(spark, d):
    p = wide(spark, d, "pages").select("page_id", "url")
    roots = p.filter(F.col("page_id") % 10 == 0).select(F.col("url").alias("root"))
    return op.prefix_semi(p, roots).select("page_id")


@query("is_foreign", """
SELECT doc_id FROM documents WHERE contains(lower(text||' '||source), 'aiou') OR contains(lower(text||' '||source), 'license')
 OR contains(lower(text||' '||source), 'src7')""")
def _(spark, d):
    return wide(spark, d, "documents").filter(op.is_foreign(("text", "source"), ("Aiou", "License"), ("SRC7",))).select("doc_id")


@query("outside_region", """
SELECT c_custkey FROM customer WHERE c_custkey%5<>4""")
def _(spark, d):
    k = F.col("c_custkey") % 5
    place = (
        F.when(k == 0, F.concat(F.col("c_name"), F.lit(" Kent 98101-1234"))).when(k == 1, "Leeds LS1 4AP")
        .when(k == 2, "BELLINGHAM Hall").when(k == 3, "Portland, Oregon").otherwise(F.col("c_name"))
    )
    return table(spark, d, "customer").filter(op.outside_region(place)).select("c_custkey")


@query("too_far_future", f"WITH {ORD} SELECT o_orderkey FROM o WHERE d > DATE '1998-01-01'+270")
def _(spark, d):
    o = _orders(spark, d).withColumn("start_date", F.col("d"))
    return o.filter(op.too_far_future(_as_of("1998-01-01"))).select("o_orderkey")


@query("dud_rules", f"""
WITH {ADDR}, x AS (SELECT o_orderkey, CASE WHEN o_orderkey%8<>0 THEN o_custkey END AS a, o_orderstatus AS st, o_orderkey%3 AS k FROM orders),
y AS (SELECT x.*, province_or_state AS p, country_id AS c FROM x LEFT JOIN addr ON a=address_id)
SELECT o_orderkey, CASE WHEN k=0 AND a IS NULL THEN 'empty_source_dance_style_url_no_address'
 WHEN p<>'BUILDING' THEN 'outside_bc_filter' WHEN c<>'ASIA' THEN 'outside_canada_filter'
 WHEN k<2 AND st='P' THEN 'empty_dance_style_url_other_no_location_description' END AS reason
FROM y WHERE reason IS NOT NULL""")
def _(spark, d):
    k = F.col("o_orderkey") % 3
    e = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_custkey")).alias("address_id"),
        F.when(k == 0, "").otherwise("src").alias("source"), F.when(k == 2, "tango").otherwise("").alias("dance_style"),
        F.when(k == 2, "u").otherwise("").alias("url"),
        F.when(F.col("o_orderstatus") == "P", "other").otherwise("class").alias("event_type"),
        F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("description"),
    )
    out = op.dud_reason(e, customer_address(spark, d), province="BUILDING", country="ASIA")
    return out.filter(F.col("reason").isNotNull()).select("o_orderkey", "reason")


@query("null_time_rules", f"""
WITH {EV}, x AS (SELECT event_id, CASE WHEN event_id%2=0 THEN start_date END AS d, CASE WHEN event_id%3=0 THEN start_sec END AS s,
 CASE WHEN event_id%5=0 THEN end_sec END AS e FROM ev) SELECT event_id FROM x WHERE (d IS NULL AND s IS NULL) OR (s IS NULL AND e IS NULL)""")
def _(spark, d):
    k = F.col("event_id")
    e = ev(spark, d).select(
        "event_id", F.when(k % 2 == 0, F.col("start_date")).alias("start_date"), F.when(k % 3 == 0, F.col("start_sec")).alias("start_sec"),
        F.when(k % 5 == 0, F.col("end_sec")).alias("end_sec"),
    )
    return e.filter(op.null_times()).select("event_id")


@query("known_incorrect", """
SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' OR p_name='blue bolt' OR p_brand IN ('Brand#4','Brand#7')""")
def _(spark, d):
    rule = op.matches_rules([("p_name", "RING")], [("p_name", "blue bolt")], {"p_brand": ("Brand#4", "Brand#7")})
    return table(spark, d, "part").filter(rule).select("p_partkey")


@query("closed_venue", "SELECT s_suppkey FROM supplier WHERE s_name ILIKE '%supplier#00000001%' OR s_name ILIKE '%000007'")
def _(spark, d):
    rule = op.matches_rules([("s_name", "SUPPLIER#00000001")]) | F.col("s_name").ilike("%000007")
    return table(spark, d, "supplier").filter(rule).select("s_suppkey")


@query("low_quality_text", """
SELECT n_nationkey, n_nationkey%3=1 AS poor_name, n_nationkey%2=0 AS poor_location FROM nation""")
def _(spark, d):
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 1, F.when(k % 2 == 0, "Bar").otherwise("ABCDEF")).otherwise(F.col("n_name"))
    place = F.when(k % 2 == 0, F.when(k % 4 == 0, "VIC,  CA").otherwise(" canada ")).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select(
        k.alias("n_nationkey"), tx.low_quality_name(name).alias("poor_name"), tx.low_quality_location(place).alias("poor_location")
    )


@query("low_value_path", f"""
SELECT page_id FROM pages WHERE list_has_any(string_split(lower({path('url')}), '/'), ['en','faq'])""")
def _(spark, d):
    return wide(spark, d, "pages").filter(u.low_value_path("url", ("en", "faq"))).select("page_id")


_SEED = """s AS (SELECT page_id, CASE WHEN page_id%10=0 THEN '' WHEN page_id%10=1 THEN 'https://www.facebook.com/sharer/x?u='||CAST(page_id AS VARCHAR)
  WHEN page_id%10 IN (2,3) THEN 'https://www.facebook.com/events/'||CAST(page_id//20 AS VARCHAR) ELSE url END AS target, page_id%10=2 AS wrapped FROM pages)"""


def _seeds(spark, d):
    k = F.col("page_id") % 10
    own = F.concat(F.lit("https://www.facebook.com/events/"), F.floor(F.col("page_id") / 20).cast("string"))
    return wide(spark, d, "pages").select(
        "page_id",
        F.when(k == 0, " ").when(k == 1, F.concat(F.lit("https://www.facebook.com/sharer/x?u="), F.col("page_id").cast("string")))
        .when(k == 2, F.concat(F.lit("https://www.facebook.com/login?next="), F.url_encode(own))).when(k == 3, own)
        .otherwise(F.col("url")).alias("link"),
    )


@query("sanitize_seeds", f"""
WITH {_SEED} SELECT target AS link, min(page_id) AS page_id FROM s WHERE target<>'' AND NOT contains(target, '/sharer/') GROUP BY target""")
def _(spark, d):
    return op.sanitize_seeds(_seeds(spark, d), "facebook.com", "page_id")[0].select("link", "page_id")


@query("sanitize_seeds_stats", f"""
WITH {_SEED} SELECT count(*) AS input_rows, count(*) FILTER (WHERE target='') AS empty_rows_dropped,
 count(*) FILTER (WHERE wrapped) AS canonicalized_rows, count(*) FILTER (WHERE contains(target,'/sharer/')) AS non_content_rows_dropped,
 count(*) FILTER (WHERE target<>'' AND NOT contains(target,'/sharer/')) - count(DISTINCT target) FILTER (WHERE target<>'' AND NOT contains(target,'/sharer/')) AS duplicate_rows_dropped,
 count(DISTINCT target) FILTER (WHERE target<>'' AND NOT contains(target,'/sharer/')) AS output_rows FROM s""")
def _(spark, d):
    return op.sanitize_seeds(_seeds(spark, d), "facebook.com", "page_id")[1]


@query("partition_seeds", """
SELECT CASE page_id%4 WHEN 0 THEN 'skipped_stale_event_detail_rows' WHEN 1 THEN 'skipped_rejected_old_event_detail_rows' ELSE 'kept_rows' END AS outcome,
 count(*) AS n FROM pages GROUP BY 1""")
def _(spark, d):
    k = F.col("page_id") % 4
    p = wide(spark, d, "pages")
    decisions = p.select(
        "page_id", (k == 3).alias("process"),
        F.when(k == 0, "skip_stale_facebook_event_detail").when(k == 1, "skip_rejected_old_facebook_event_detail")
        .otherwise("skip_default_rules").alias("decision_reason"),
    )
    skip = {
        "skip_stale_facebook_event_detail": "skipped_stale_event_detail_rows",
        "skip_stale_facebook_blocked_url": "skipped_stale_event_detail_rows",
        "skip_rejected_old_facebook_event_detail": "skipped_rejected_old_event_detail_rows",
    }
    return op.partition_seeds(p.select("page_id"), decisions, "page_id", skip).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("stale_cdn_urls", """
SELECT count(*) AS total_count, count(*) FILTER (WHERE event_type LIKE '%click%') AS click_count,
 count(*) FILTER (WHERE event_type LIKE '%view%') AS view_count FROM events
WHERE (event_type LIKE '%click%' OR event_type LIKE '%view%') AND ts < TIMESTAMP '2024-01-31' - INTERVAL 2 DAY""")
def _(spark, d):
    return op.stale_urls(table(spark, d, "events"), "event_type", "ts", ("click", "view"), F.lit("2024-01-31").cast("date"), 2)


@query("overtagged", """
SELECT doc_id FROM documents WHERE len(string_split(lang||','||source||',x', ','))>2 AND NOT contains(lower(text), 'the') AND NOT contains(lower(text), 'tango')""")
def _(spark, d):
    tags = F.concat_ws(",", "lang", "source", F.lit("x"))
    return wide(spark, d, "documents").filter(op.overtagged(tags, ("text",), ("the", "tango"), 2)).select("doc_id")


@query("bad_datetime_split", f"""
WITH {ORD} SELECT o_orderkey, o_orderkey%6<>0 AS parsed FROM o""")
def _(spark, d):
    raw = F.when(F.col("o_orderkey") % 6 == 0, "Sometime 25:99").otherwise(F.concat(F.col("d").cast("string"), F.lit(" 19:30:00")))
    ok, bad = op.split_bad_stamp(_orders(spark, d).select("o_orderkey", raw.alias("stamp")), "stamp")
    return ok.select("o_orderkey", F.lit(True).alias("parsed")).unionByName(bad.select("o_orderkey", F.lit(False).alias("parsed")))


@query("has_event_signal", """
SELECT doc_id, contains(lower(text), 'social') OR contains(lower(text), 'class') OR contains(lower(text), 'ander') AS signal FROM documents""")
def _(spark, d):
    return wide(spark, d, "documents").select("doc_id", op.has_event_signal("text", ("social", "class", "ander")).alias("signal"))


@query("active_sources", """
SELECT p_partkey, CASE WHEN p_size%5=0 THEN 'disabled' WHEN p_size>40 THEN 'before_active_start_date' WHEN p_size<10 THEN 'after_active_end_date' ELSE 'active' END AS reason FROM part""")
def _(spark, d):
    size = F.col("p_size")
    p = table(spark, d, "part").select(
        "p_partkey", F.when(size % 5 == 0, "No").otherwise("").alias("enabled"),
        F.when(size > 40, F.date_add(_as_of(), 1)).alias("active_start_date"), F.when(size < 10, F.date_sub(_as_of(), 1)).alias("active_end_date"),
    )
    return p.select("p_partkey", op.is_active_source(_as_of())["reason"].alias("reason"))


@query("incomplete_addresses", f"WITH {ADDR} SELECT address_id FROM addr WHERE address_id%7=0 OR address_id%11=0")
def _(spark, d):
    a = customer_address(spark, d).withColumns({
        "city": F.when(F.col("address_id") % 7 == 0, " ").otherwise(F.col("city")),
        "street_name": F.when(F.col("address_id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("street_name")),
    })
    return a.filter(op.incomplete_address(("street_number", "street_name", "city", "province_or_state", "country_id"))).select("address_id")


_PROB = """p AS (SELECT o_orderkey AS event_id, o_orderpriority AS n, CASE WHEN o_orderkey%4=0 THEN NULL WHEN o_orderkey%4=1 THEN 'Short' ELSE repeat('Long ', 6) END AS l,
 CASE WHEN o_orderkey%4=2 THEN o_custkey END AS a FROM orders)"""


@query("problem_groups", f"""
WITH {_PROB} SELECT min(event_id) AS first_event_id, count(*) AS rows, false AS empty FROM p WHERE a IS NULL OR a=0 OR l IS NULL OR length(trim(l))<20 GROUP BY n, l""")
def _(spark, d):
    k = F.col("o_orderkey") % 4
    e = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event_name"), F.lit(None).cast("string").alias("description"),
        F.when(k == 1, "Short").when(k > 1, "Long " * 6).alias("location"), F.when(k == 2, F.col("o_custkey")).alias("address_id"),
    )
    return op.problem_groups(op.problem_rows(e)).select("first_event_id", "rows", "empty")


@query("url_relevance", f"""
WITH s AS (SELECT page_id, translate(lower({path('url')}||' '||{qry('url')}), '-_', '  ') AS slug FROM pages)
SELECT page_id, CASE WHEN contains(slug, '/en/') OR contains(slug, 'salsa') THEN true WHEN contains(slug, 'ref=') THEN false END AS relevant FROM s""")
def _(spark, d):
    return wide(spark, d, "pages").select("page_id", u.url_relevance("url", ("/en/", "salsa"), ("ref=",)).alias("relevant"))
