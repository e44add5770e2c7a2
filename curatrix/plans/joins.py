"""Join operators over the benchmark data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as op
from ..operators import metrics
from ..sources.adapters import crawl_log, ev, table
from .common import EV, LOG
from .registry import query


def _day(text):
    return F.lit(text).cast("date")


def _u(c):
    return F.concat(F.lit("u"), F.col(c).cast("string"))


_DEC = f"""{LOG}, agg AS (SELECT link, arg_max(relevant, time_stamp) AS last, count(*) AS n,
  CASE WHEN count(*) FILTER (WHERE relevant)=0 THEN 0 WHEN count(*) FILTER (WHERE NOT relevant)=0 THEN 1 ELSE count(*) FILTER (WHERE relevant)/count(*) FILTER (WHERE NOT relevant) END AS r FROM log GROUP BY link),
 hist AS (SELECT 'u'||CAST(o_custkey AS VARCHAR) AS url, max(CAST(o_orderdate AS DATE)) AS hd FROM orders WHERE o_custkey%4<>0 GROUP BY 1),
 x AS (SELECT c_custkey, 'u'||CAST(c_custkey AS VARCHAR) AS link FROM customer),
 dec AS (SELECT x.link, CASE WHEN starts_with(x.link, 'u12') THEN 'process_whitelisted' WHEN agg.link IS NULL THEN 'process_never_seen'
  WHEN c_custkey%10=5 AND hd<DATE '2001-07-01' THEN 'skip_stale_numbered_detail' WHEN c_custkey%13=0 THEN 'skip_stale_facebook_blocked_url'
  WHEN last AND coalesce(hd<DATE '2001-07-01'-7, true) THEN 'process_last_relevant_and_stale_date' WHEN NOT last AND c_custkey IN (7, 17, 27) THEN 'skip_low_value_path_after_irrelevant'
  WHEN r>=0.5 OR n<=2 THEN 'process_strong_hit_ratio_or_early_retry' ELSE 'skip_default_rules' END AS decision_reason
  FROM x LEFT JOIN agg USING (link) LEFT JOIN hist ON url=x.link)"""


def _decisions(spark, d):
    log = crawl_log(spark, d).withColumn("decision_reason", F.lit(None).cast("string"))
    cust = table(spark, d, "customer")
    hist = table(spark, d, "orders").filter("o_custkey % 4 <> 0").select(_u("o_custkey").alias("url"), F.to_date("o_orderdate").alias("start_date"))
    return op.crawl_decisions(
        cust.select(_u("c_custkey").alias("link")), log, hist,
        cust.filter("c_custkey % 13 = 0").select(_u("c_custkey").alias("url")),
        cust.filter("c_custkey = 12").select(_u("c_custkey").alias("root")),
        _day("2001-07-01"), 7, (("numbered_detail", "^$", "^u[0-9]*5$"),), None, ("u7", "u17", "u27"),
    )


@query("should_process", f"WITH {_DEC} SELECT link, decision_reason, starts_with(decision_reason, 'process_') AS process FROM dec")
def _(spark, d):
    return _decisions(spark, d)


@query("decision_counts", f"WITH {_DEC} SELECT decision_reason, count(*) AS counted FROM dec GROUP BY 1")
def _(spark, d):
    return metrics.count_by(_decisions(spark, d), "decision_reason")


TWINS = """SELECT DISTINCT a.event_id FROM ev a JOIN ev b ON a.place=b.place AND a.start_date=b.start_date AND a.event_id<b.event_id
 AND abs(a.start_sec-b.start_sec)<=900 AND abs(a.end_sec-b.end_sec)<=900"""


@query("time_window_duplicates", f"WITH {EV} {TWINS}")
def _(spark, d):
    return op.time_window_losers(ev(spark, d), ["place", "start_date"])


@query("deduplicated_source_counts", f"""
WITH {EV}, lost AS ({TWINS}) SELECT source, count(*) AS counted FROM ev
WHERE start_date >= DATE '2024-01-31'-20 AND event_id NOT IN (SELECT event_id FROM lost) GROUP BY source""")
def _(spark, d):
    # twins share their date, so old rows can go before the de-duplication
    fresh = ev(spark, d).filter(F.col("start_date") >= F.date_sub(_day("2024-01-31"), 20))
    return metrics.count_by(op.drop_time_window_duplicates(fresh, ["place", "start_date"]), "source")


_SLOT = "SELECT event_id, CAST(start_date AS VARCHAR) AS start_date, place, start_sec//3600 AS slot, event_type FROM ev WHERE start_date>=DATE '2024-01-05'"


def _slots(spark, d):
    e = ev(spark, d).filter(F.col("start_date") >= _day("2024-01-05"))
    return e.select("event_id", F.col("start_date").cast("string").alias("start_date"), "place", F.floor(F.col("start_sec") / 3600).alias("slot"), "event_type")


@query("venue_time_conflicts", f"""
WITH {EV}, s AS ({_SLOT}) SELECT a.start_date, a.place, a.slot, a.event_id AS event_id_1, b.event_id AS event_id_2, a.event_type AS event_type_1, b.event_type AS event_type_2
FROM s a JOIN s b ON a.start_date=b.start_date AND a.place=b.place AND a.slot=b.slot AND a.event_id<b.event_id AND a.event_type<>b.event_type""")
def _(spark, d):
    return op.venue_conflict_pairs(_slots(spark, d), ["start_date", "place", "slot"], "event_type")


@query("venue_conflict_rows", f"""
WITH {EV}, s AS ({_SLOT}) SELECT a.event_id, count(*) AS conflicts, min(b.event_id) AS first_conflict_id
FROM s a JOIN s b ON a.start_date=b.start_date AND a.place=b.place AND a.slot=b.slot AND a.event_type<>b.event_type GROUP BY 1""")
def _(spark, d):
    return op.venue_conflict_rows(_slots(spark, d), ["start_date", "place", "slot"], "event_type").select("event_id", "conflicts", "first_conflict_id")


@query("orphans", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey=l_orderkey AND o_orderstatus<>'P')""")
def _(spark, d):
    parent = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    return op.orphans(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parent, "l_orderkey", "o_orderkey")


@query("clear_orphans", """
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment<>'MACHINERY') THEN o_custkey ELSE 0 END AS o_custkey FROM orders""")
def _(spark, d):
    dim = table(spark, d, "customer").filter("c_mktsegment <> 'MACHINERY'")
    return op.clear_orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), dim, "o_custkey", "c_custkey")


@query("sync_from_dim", """
SELECT o_orderkey, coalesce(c_name, o_orderpriority) AS location FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey<12) ON o_custkey=c_custkey""")
def _(spark, d):
    fact = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("location"))
    dim = table(spark, d, "customer").filter("c_nationkey < 12")
    return op.sync_from_dim(fact, dim, "o_custkey", "c_custkey", "location", "c_name").select("o_orderkey", "location")


@query("apply_labels", """
SELECT doc_id, CASE WHEN quality IS NULL THEN 'keep' WHEN doc_id%20=1 THEN 'invalid' WHEN quality=1 THEN 'delete' ELSE 'keep' END AS decision
FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, d):
    k = F.col("doc_id") % 20
    labels = table(spark, d, "labels").select("doc_id", F.when(k == 1, "7").when(F.col("quality") == 0, "-1").otherwise("1.0").alias("label"))
    return op.apply_labels(table(spark, d, "documents").select("doc_id"), labels, "doc_id", "label").select("doc_id", "decision")


@query("fill_missing_keys", """
WITH r AS (SELECT 'hall '||CAST(n_nationkey AS VARCHAR) AS m, n_nationkey*100 AS v, CASE WHEN n_nationkey%2=0 THEN 'Hall '||CAST(n_nationkey AS VARCHAR)||', '||n_name ELSE n_name END AS f FROM nation WHERE n_nationkey%6<>0)
SELECT o_orderkey, coalesce(CASE WHEN o_custkey%3<>0 THEN o_custkey END, v) AS address_id,
 CASE WHEN v IS NOT NULL THEN CASE WHEN starts_with(lower(f), m) THEN f ELSE 'Hall '||CAST(o_custkey%25 AS VARCHAR)||', '||f END ELSE 'HALL '||CAST(o_custkey%25 AS VARCHAR) END AS location
FROM orders LEFT JOIN r ON o_custkey%3=0 AND m='hall '||CAST(o_custkey%25 AS VARCHAR)""")
def _(spark, d):
    n = F.col("n_nationkey")
    hall = F.concat(F.lit("Hall "), n.cast("string"))
    rules = table(spark, d, "nation").select(
        n.alias("rule_order"), hall.alias("match_text"), (n * 100).cast("bigint").alias("key_value"),
        F.when(n % 6 == 0, "").when(n % 2 == 0, F.concat_ws(", ", hall, "n_name")).otherwise(F.col("n_name")).alias("full_text"),
    )
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("address_id"),
        F.concat(F.lit("HALL "), (F.col("o_custkey") % 25).cast("string")).alias("location"),
    )
    return op.fill_missing(o, rules, "address_id", "location").select("o_orderkey", "address_id", "location")


@query("history_reuse", """
WITH h AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS sd FROM orders WHERE o_custkey%3<>0),
u AS (SELECT o_custkey, sd>DATE '2001-07-01'+7 AS up, sd, o_orderkey FROM h),
g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE up) AS nu, count(DISTINCT sd) FILTER (WHERE up) AS ids, max(o_orderkey) FILTER (WHERE up) AS ev FROM u GROUP BY 1)
SELECT 'u'||CAST(c_custkey AS VARCHAR) AS link, CASE WHEN c_custkey%2=0 THEN 'not_static_event_detail' WHEN n IS NULL THEN 'no_history_rows' WHEN nu=0 THEN 'no_upcoming_history_outside_rescrape_window'
 WHEN ids>1 THEN 'ambiguous_history_match' ELSE 'history_reuse_static_event_detail' END AS reason,
 CASE WHEN c_custkey%2=1 AND nu>0 AND ids=1 THEN ev ELSE -1 END AS event_id FROM customer LEFT JOIN g ON o_custkey=c_custkey""")
def _(spark, d):
    hist = table(spark, d, "orders").filter("o_custkey % 3 <> 0").select(
        F.col("o_orderkey").alias("event_id"), _u("o_custkey").alias("url"), F.lit("Show").alias("event_name"), F.to_date("o_orderdate").alias("start_date"),
        F.to_date("o_orderdate").alias("end_date"), F.lit(1).alias("start_sec"), F.lit(2).alias("end_sec"), F.lit("2001-01-01").alias("time_stamp"),
    )
    urls = table(spark, d, "customer").select(_u("c_custkey").alias("link"))
    out = op.history_reuse(urls, hist, _day("2001-07-01"), 7, (("odd", "^$", "^u[0-9]*[13579]$"),))
    return out.select("link", "reason", F.coalesce("event.event_id", F.lit(-1)).alias("event_id"))


@query("routing_memory", """
WITH m AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, user_id%40 AS link, CASE WHEN event_type<>'purchase' THEN 'a' ELSE event_type END AS arch, event_type AS stage, value AS conf, ts FROM events),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY run, link ORDER BY ts DESC)=1),
r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, user_id%40 AS link, bool_and(value<120) AS ok FROM events GROUP BY 1, 2),
t AS (SELECT l.*, ok FROM l JOIN r USING (run, link) QUALIFY row_number() OVER (PARTITION BY link ORDER BY ts DESC)<=24),
c AS (SELECT link, arch, count(*) AS n, count(*) FILTER (WHERE ok) AS s, avg(conf) AS ac, sum(count(*)) OVER (PARTITION BY link) AS tot FROM t GROUP BY 1, 2),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY link ORDER BY n DESC, arch DESC)=1),
st AS (SELECT link, arch, stage FROM t GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY link, arch ORDER BY count(*) DESC, stage)=1)
SELECT 'u'||CAST(link AS VARCHAR) AS link, arch AS archetype, n AS sample_count, s AS success_count, round(s/n, 4) AS success_rate, round(n/tot, 4) AS dominance,
 round(ac, 4) AS avg_confidence, stage AS stage_mode FROM b JOIN st USING (link, arch) WHERE n>=3 AND n/tot>=0.7 AND s>=3 AND s/n>=0.5""")
def _(spark, d):
    e = table(spark, d, "events").withColumns({"run_id": F.to_date("ts").cast("string"), "k": F.col("user_id") % 40})
    m = e.select(
        "run_id", _u("k").alias("link"), F.when(F.col("event_type") != "purchase", "a").otherwise(F.col("event_type")).alias("archetype"),
        F.lit("s").alias("owner_step"), F.lit("").alias("subtype"), F.col("event_type").alias("stage"), F.col("value").alias("confidence"), F.col("ts").alias("time_stamp"),
    )
    r = e.select("run_id", _u("k").alias("url"), (F.col("value") < 120).alias("is_match"))
    return op.routing_memory(m, r, 3, 0.7, 0.5, 24).drop("owner_step", "subtype")


@query("audit_capture", """
SELECT o_orderkey, o_orderkey%4<>0 AS captured FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    return op.audit_capture(o, o.filter("o_orderkey % 4 <> 0"), ["o_orderkey", "o_custkey", "d"]).select("o_orderkey", "captured")


_IMP = """imp AS (SELECT 'https://h'||CAST(c_custkey AS VARCHAR)||'.org' AS url, CASE WHEN c_custkey%2=0 THEN 'whitelist' ELSE 'edge_case' END AS importance, c_custkey FROM customer),
 lg AS (SELECT user_id, ts, event_type='purchase' AS relevant, CAST(event_id%5 AS INTEGER) AS t FROM events WHERE ts<TIMESTAMP '2024-01-30' OR user_id%9<>0)"""
_FAIL = f"""{_IMP}, h AS (SELECT imp.*, ts, relevant, t, ts>=TIMESTAMP '2024-01-31'-CASE WHEN importance='whitelist' THEN INTERVAL 4 DAY ELSE INTERVAL 2 DAY END AS inw FROM imp JOIN lg ON user_id=c_custkey),
 ever AS (SELECT DISTINCT c_custkey FROM h), r5 AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY ts DESC) AS rn FROM h WHERE inw QUALIFY rn<=5),
 r AS (SELECT c_custkey, count(*) AS n, count(*) FILTER (WHERE relevant) AS ok, coalesce(min(rn) FILTER (WHERE relevant)-1, count(*)) AS streak, arg_min(t, rn) AS t FROM r5 GROUP BY 1),
 fl AS (SELECT url, importance, c_custkey, CASE WHEN n IS NULL THEN 'not_attempted' WHEN ok=0 AND streak>=CASE WHEN importance='whitelist' THEN 4 ELSE 2 END THEN 'marked_irrelevant' WHEN ok=0 AND t>=3 THEN 'multiple_retries' END AS failure_type,
  coalesce(n, 0) AS recent_rows, coalesce(streak, 0) AS consecutive_irrelevant, coalesce(t, 0) AS crawl_attempts, ever.c_custkey IS NOT NULL AS seen FROM imp LEFT JOIN r USING (c_custkey) LEFT JOIN ever USING (c_custkey)
  WHERE NOT (c_custkey%11=0 AND ((n IS NULL) OR (ok=0 AND streak>=CASE WHEN importance='whitelist' THEN 4 ELSE 2 END))))"""


def _failures(spark, d):
    k = F.col("c_custkey")
    imp = table(spark, d, "customer").select(
        F.concat(F.lit("https://h"), k.cast("string"), F.lit(".org")).alias("url"), F.lit("s").alias("source"),
        F.when(k % 2 == 0, "whitelist").otherwise("edge_case").alias("importance"),
    )
    late = F.col("ts") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    host = F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".org"))
    log = table(spark, d, "events").filter(late | (F.col("user_id") % 9 != 0)).select(
        host.alias("link"), F.lit("").alias("parent_url"), (F.col("event_type") == "purchase").alias("relevant"), (F.col("event_id") % 5).cast("int").alias("crawl_try"),
        F.lit("k").alias("keywords"), F.col("ts").alias("time_stamp"),
    )
    child = table(spark, d, "customer").filter("c_custkey % 11 = 0").select(
        F.lit("child").alias("link"), F.concat(F.lit("https://h"), k.cast("string"), F.lit(".org")).alias("parent_url"), F.lit(True).alias("relevant"), F.lit(1).alias("crawl_try"),
        F.lit("").alias("keywords"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz").alias("time_stamp"),
    )
    return imp, op.url_failures(imp, log.unionByName(child), _day("2024-01-31"), {"whitelist": 4}, {"whitelist": 4}, 2, 2)


@query("important_url_failures", f"""
WITH {_FAIL} SELECT url, importance, failure_type, CASE failure_type WHEN 'not_attempted' THEN CASE WHEN seen THEN 'not_seen_in_window_historical_exists' ELSE 'no_recent_url_rows' END
 WHEN 'marked_irrelevant' THEN 'recent_irrelevant_threshold_reached' ELSE 'retry_threshold_with_no_success' END AS reason_code, recent_rows, consecutive_irrelevant, crawl_attempts
FROM fl WHERE failure_type IS NOT NULL""")
def _(spark, d):
    return _failures(spark, d)[1].select("url", "importance", "failure_type", "reason_code", "recent_rows", "consecutive_irrelevant", "crawl_attempts")


@query("failure_summary", f"""
WITH {_FAIL}, t AS (SELECT importance, count(*) AS total FROM imp GROUP BY 1)
SELECT failure_type, importance, count(*) AS failures, round(100.0*count(*)/any_value(total), 2) AS failure_pct FROM fl JOIN t USING (importance) WHERE failure_type IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    imp, fails = _failures(spark, d)
    return metrics.failure_summary(fails, imp).select("failure_type", "importance", "failures", "failure_pct")


@query("not_attempted_reasons", f"""
WITH {_FAIL} SELECT url, CASE WHEN c_custkey%3=0 THEN 'explicit_url_run_limit_skip' WHEN c_custkey%3=1 THEN 'explicit_should_process_url_skip' ELSE 'unattributed_with_global_run_limit' END AS category
FROM fl WHERE failure_type='not_attempted'""")
def _(spark, d):
    k = F.col("c_custkey")
    page = F.concat(F.lit("HTTPS://h"), k.cast("string"), F.lit(".org"))
    lines = table(spark, d, "customer").filter("c_custkey % 3 <> 2").select(
        F.when(k % 3 == 0, F.concat(F.lit("Skipping non-whitelist link: "), page, F.lit(", URL run limit reached")))
        .otherwise(F.concat(F.lit("should_process_url: skip "), page)).alias("line")
    )
    return op.attempt_reasons(_failures(spark, d)[1], lines)
