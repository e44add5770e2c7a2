"""Metric tables over the benchmark data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as op
from ..sources.adapters import crawl_log, customer_address, table
from .common import ADDR, LOG, ORD
from .registry import query


def _as_of(day):
    return F.lit(day).cast("date")


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("d", F.to_date("o_orderdate"))


@query("count_by_source", "SELECT event_type, count(*) AS counted FROM events GROUP BY event_type")
def _(spark, d):
    return op.count_by(table(spark, d, "events"), "event_type")


_HIT = """hits AS (SELECT link, CASE WHEN count(*) FILTER (WHERE relevant)=0 THEN 0 WHEN count(*) FILTER (WHERE NOT relevant)=0 THEN 1
 ELSE count(*) FILTER (WHERE relevant)/count(*) FILTER (WHERE NOT relevant) END AS hit_ratio, sum(crawl_try) AS crawl_try FROM log GROUP BY link)"""


@query("url_hit_ratio", f"WITH {LOG}, {_HIT} SELECT link, round(hit_ratio, 6) AS hit_ratio, CAST(crawl_try AS BIGINT) AS crawl_try FROM hits")
def _(spark, d):
    return op.hit_ratio(crawl_log(spark, d)).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query("high_performers", f"""
WITH {LOG} SELECT link, round(count(*) FILTER (WHERE relevant)/count(*), 6) AS hit_ratio, count(*) AS total_attempts FROM log
GROUP BY link HAVING count(*)>=3 AND count(*) FILTER (WHERE relevant)/count(*)>0.4""")
def _(spark, d):
    hp = op.high_performers(crawl_log(spark, d), ["link"], 3, 0.4)
    return hp.select("link", F.round("hit_ratio", 6).alias("hit_ratio"), "total_attempts")


def _step_metrics(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(
        F.when(c("l_returnflag") != "N", F.concat(F.lower("l_returnflag"), F.lit(".py"))).otherwise("").alias("handled_by"),
        F.lower("l_linestatus").alias("step_name"),
        F.lit(True).alias("access_attempted"), (c("l_tax") < 0.07).alias("access_succeeded"), (c("l_tax") < 0.05).alias("text_extracted"),
        ((c("l_tax") < 0.05) & (c("l_discount") < 0.05)).alias("keywords_found"), (c("l_discount") < 0.06).alias("extraction_attempted"),
        (c("l_discount") < 0.03).alias("extraction_succeeded"), (c("l_linenumber") == 1).alias("ocr_attempted"),
        ((c("l_linenumber") == 1) & (c("l_quantity") > 20)).alias("ocr_succeeded"), (c("l_linenumber") == 2).alias("vision_attempted"),
        ((c("l_linenumber") == 2) & (c("l_quantity") > 30)).alias("vision_succeeded"), (c("l_linenumber") == 9).alias("fallback_used"),
        (c("l_quantity").cast("int") % 4).alias("events_written"),
    )


_SM = """sm AS (SELECT CASE WHEN l_returnflag<>'N' THEN lower(l_returnflag) ELSE lower(l_linestatus) END AS step, true AS aa, l_tax<0.07 AS asu, l_tax<0.05 AS te,
 l_tax<0.05 AND l_discount<0.05 AS kf, l_discount<0.06 AS ea, l_discount<0.03 AS es, l_linenumber=1 AS oa, l_linenumber=1 AND l_quantity>20 AS os,
 l_linenumber=2 AS va, l_linenumber=2 AND l_quantity>30 AS vs, l_linenumber=9 AS fu, CAST(l_quantity AS BIGINT)%4 AS ew FROM lineitem)"""


def _p(a, b):
    return f"coalesce(round(100.0*(count(*) FILTER (WHERE {a}))/nullif(count(*) FILTER (WHERE {b}), 0), 2), 0)"


@query("step_telemetry", f"""
WITH {_SM} SELECT step, count(*) AS total_urls, count(*) FILTER (WHERE aa) AS access_attempted_count, count(*) FILTER (WHERE asu) AS access_succeeded_count,
 count(*) FILTER (WHERE te) AS text_extracted_count, count(*) FILTER (WHERE kf) AS keywords_found_count, count(*) FILTER (WHERE ea) AS extraction_attempted_count,
 count(*) FILTER (WHERE es) AS extraction_succeeded_count, count(*) FILTER (WHERE oa) AS ocr_attempted_count, count(*) FILTER (WHERE os) AS ocr_succeeded_count,
 count(*) FILTER (WHERE va) AS vision_attempted_count, count(*) FILTER (WHERE vs) AS vision_succeeded_count, count(*) FILTER (WHERE fu) AS fallback_used_count,
 count(*) FILTER (WHERE ew>0) AS urls_with_events_count, CAST(sum(ew) AS BIGINT) AS events_written_total,
 {_p('asu', 'aa')} AS access_success_rate_pct, {_p('te', 'aa')} AS text_extracted_rate_pct, {_p('kf', 'te')} AS keyword_hit_rate_pct,
 {_p('es', 'ea')} AS extraction_success_rate_pct, {_p('os', 'oa')} AS ocr_success_rate_pct, {_p('vs', 'va')} AS vision_success_rate_pct,
 {_p('fu', 'ea')} AS fallback_usage_rate_pct FROM sm GROUP BY step""")
def _(spark, d):
    return op.step_telemetry(_step_metrics(spark, d))


@query("telemetry_integrity", f"""
WITH m AS (SELECT lower(o_orderpriority) AS step, sum(o_orderkey%3) AS me FROM orders GROUP BY 1),
w AS (SELECT lower(o_orderpriority) AS step, count(*) AS wr FROM orders JOIN lineitem ON o_orderkey=l_orderkey WHERE o_orderkey%2=0 GROUP BY 1),
x AS (SELECT event_type AS step, count(*) AS dr, count(*) FILTER (WHERE event_id%100=0) AS ur FROM events GROUP BY 1),
j AS (SELECT coalesce(m.step, w.step, x.step) AS step, coalesce(me,0) AS me, coalesce(wr,0) AS wr, coalesce(dr,0) AS dr, coalesce(ur,0) AS ur
 FROM m FULL JOIN w USING (step) FULL JOIN x ON x.step=coalesce(m.step,w.step))
SELECT step, CAST(me AS BIGINT) AS metrics_events, wr AS write_rows, dr AS delete_rows, ur AS unknown_reasons, CAST(me-wr AS BIGINT) AS delta,
 CASE WHEN ur>0 THEN 'FAIL' WHEN me<>wr THEN 'WARN' ELSE 'PASS' END AS status FROM j""")
def _(spark, d):
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem").select("l_orderkey")
    metrics = o.select(F.concat(F.col("o_orderpriority"), F.lit(".py")).alias("handled_by"), F.lit("").alias("step_name"), (F.col("o_orderkey") % 3).alias("events_written"))
    writes = o.filter("o_orderkey % 2 = 0").join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_orderpriority").alias("step_name"))
    deletes = table(spark, d, "events").select(F.col("event_type").alias("step_name"), (F.col("event_id") % 100 != 0).alias("reason_registered"))
    return op.step_integrity(metrics, writes, deletes)


@query("duplicate_attribution", """
SELECT 'write' AS "table", count(*)-count(DISTINCT l_orderkey) AS duplicate_rows FROM lineitem
UNION ALL SELECT 'delete', count(*)-count(DISTINCT o_custkey) FROM orders""")
def _(spark, d):
    return op.duplicate_attribution(
        table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id")),
        table(spark, d, "orders").select(F.col("o_custkey").alias("event_id")),
    )


@query("source_distribution", """
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT DISTINCT 'Brand#'||CAST(n_nationkey*3 AS VARCHAR) AS required_source FROM nation)
SELECT required_source, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, coalesce(sum(n), 0)>0 AS present
FROM r LEFT JOIN c ON contains(p_brand, required_source) OR contains(required_source, p_brand) GROUP BY 1""")
def _(spark, d):
    required = table(spark, d, "nation").select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") * 3).cast("string")).alias("required_source"))
    return op.source_presence(table(spark, d, "part"), "p_brand", required)


@query("source_total_range", "SELECT count(*) AS total_events, CASE WHEN count(*) BETWEEN 1000 AND 2000 THEN 'PASS' ELSE 'WARNING' END AS status FROM part")
def _(spark, d):
    return op.total_range(table(spark, d, "part"), 1000, 2000)


@query("training_queue", """
WITH r AS (SELECT 'c'||CAST(o_custkey AS VARCHAR) AS url, o_orderstatus='F' OR o_custkey%4=0 AS ok,
  CASE WHEN o_custkey%3=0 THEN 'content_drift_major' WHEN o_custkey%3=1 THEN 'wrong_date' ELSE '' END AS cat, o_custkey%5 AS a FROM orders),
g AS (SELECT url, count(*) AS total_rows, count(*) FILTER (WHERE ok) AS t, count(*) FILTER (WHERE NOT ok) AS f, any_value(cat) AS cat, any_value(a) AS a FROM r GROUP BY url),
l AS (SELECT n_regionkey AS a, count(*) AS n FROM nation WHERE n_nationkey<13 GROUP BY 1),
s AS (SELECT g.*, CASE WHEN t>0 AND f=0 THEN 'auto_positive_candidate' WHEN t=0 AND cat='content_drift_major' THEN 'classifier_review_needed'
  WHEN t=0 AND cat='wrong_date' THEN 'extraction_issue' WHEN t>0 AND f>0 THEN 'mixed_signal' ELSE 'manual_review_needed' END AS status FROM g)
SELECT url, total_rows, t AS true_count, f AS false_count, round(100.0*t/total_rows, 2) AS match_rate_pct, status, status='auto_positive_candidate' AS training_eligible,
 CAST(CASE status WHEN 'auto_positive_candidate' THEN 100 WHEN 'classifier_review_needed' THEN 60 WHEN 'mixed_signal' THEN 30 WHEN 'manual_review_needed' THEN 20 ELSE 0 END
  + ((SELECT max(n) FROM l)-coalesce(l.n,0))*3 + ((SELECT max(n) FROM l)-coalesce(l.n,0))*2 AS BIGINT) AS priority_score
FROM s LEFT JOIN l USING (a)""")
def _(spark, d):
    return _queue(spark, d).select("url", "total_rows", "true_count", "false_count", "match_rate_pct", "status", "training_eligible", "priority_score")


def _queue(spark, d):
    k = F.col("o_custkey")
    replay = table(spark, d, "orders").select(
        F.concat(F.lit("c"), k.cast("string")).alias("url"), ((F.col("o_orderstatus") == "F") | (k % 4 == 0)).alias("is_match"),
        F.when(k % 3 == 0, "content_drift_major").when(k % 3 == 1, "wrong_date").otherwise("").alias("mismatch_category"),
        (k % 5).cast("string").alias("archetype"), (k % 5).cast("string").alias("owner_step"),
    )
    reviewed = table(spark, d, "nation").filter("n_nationkey < 13").select(
        F.col("n_regionkey").cast("string").alias("reviewed_archetype"), F.col("n_regionkey").cast("string").alias("reviewed_owner")
    )
    return op.training_queue(replay, reviewed)


@query("training_queue_order", """
SELECT 'c'||CAST(o_custkey AS VARCHAR) AS url FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus='F' OR o_custkey%4=0) AS t,
 count(*) FILTER (WHERE NOT(o_orderstatus='F' OR o_custkey%4=0)) AS f FROM orders GROUP BY 1) WHERE t>0 AND f=0
ORDER BY 5*((SELECT max(n) FROM (SELECT count(*) AS n FROM nation WHERE n_nationkey<13 GROUP BY n_regionkey))
 -coalesce((SELECT count(*) FROM nation WHERE n_nationkey<13 AND n_regionkey=o_custkey%5),0)) DESC, url LIMIT 25""")
def _(spark, d):
    return _queue(spark, d).filter("training_eligible").orderBy(*op.queue_order()).limit(25).select("url")


@query("field_accuracy", """
WITH p AS (SELECT o_custkey%7<>0 AS dm, o_custkey%5<>0 AS tm, CASE WHEN o_orderstatus='P' THEN NULL ELSE o_orderkey%3=0 END AS pm FROM orders)
SELECT 'start_date' AS field, round(100*avg(CAST(dm AS INT)), 2) AS accuracy_pct FROM p
UNION ALL SELECT 'start_time', round(100*avg(CAST(tm AS INT)), 2) FROM p UNION ALL SELECT 'source', round(100*avg(CAST(pm AS INT)), 2) FROM p""")
def _(spark, d):
    k = F.col("o_custkey")
    yes = F.lit(True)
    return op.field_accuracy(
        table(spark, d, "orders"),
        {"start_date": k % 7 != 0, "start_time": k % 5 != 0, "source": F.col("o_orderkey") % 3 == 0},
        {"start_date": yes, "start_time": yes, "source": F.col("o_orderstatus") != "P"},
    )


_DOM = """u AS (SELECT event_type, user_id, bool_and(value<60) AS ok FROM events GROUP BY 1, 2),
 dm AS (SELECT event_type, count(*) AS urls, count(*) FILTER (WHERE ok) AS success_urls, round(100*avg(CAST(ok AS INT)), 2) AS accuracy_pct FROM u GROUP BY 1)"""


def _domains(spark, d):
    return op.domain_accuracy(table(spark, d, "events").withColumn("ok", F.col("value") < 60), "user_id", "event_type", "ok")


@query("domain_accuracy", f"WITH {_DOM} SELECT * FROM dm")
def _(spark, d):
    return _domains(spark, d)


@query("best_and_worst_domains", f"""
WITH {_DOM} SELECT event_type, accuracy_pct, 'best' AS side FROM (SELECT * FROM dm ORDER BY accuracy_pct DESC, event_type LIMIT 2)
UNION ALL SELECT event_type, accuracy_pct, 'worst' FROM (SELECT * FROM dm ORDER BY accuracy_pct, event_type LIMIT 2)""")
def _(spark, d):
    return op.best_and_worst(_domains(spark, d), "event_type", 2).select("event_type", "accuracy_pct", "side")


@query("data_quality_rates", f"""
WITH {ORD} SELECT count(*) AS total, round(100.0*count(*) FILTER (WHERE o_totalprice<10000)/count(*), 2) AS invalid_pct,
 round(100.0*count(*) FILTER (WHERE d<DATE '2001-08-01'-365)/count(*), 2) AS stale_pct FROM o""")
def _(spark, d):
    return op.quality_rates(_orders(spark, d), F.col("o_totalprice") < 10000, F.col("d") < F.date_sub(_as_of("2001-08-01"), 365))


@query("stage_domain_accuracy", """
SELECT coalesce(stage, 'all') AS stage, coalesce(domain, 'all') AS domain, count(*) AS n, round(100*avg(CAST(ok AS INT)), 2) AS accuracy_pct,
 round(avg(c), 4) AS mean_confidence FROM (SELECT event_type AS stage, 'd'||CAST(user_id%5 AS VARCHAR) AS domain, value<50 AS ok, value/1000 AS c FROM events)
GROUP BY ROLLUP (stage, domain)""")
def _(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("stage"), F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("domain"),
        (F.col("value") < 50).alias("success"), (F.col("value") / 1000).alias("confidence"),
    )
    return op.stage_accuracy(e).fillna("all", ["stage", "domain"])


@query("test_summary", """
SELECT lang, count(*) AS tests, round(avg(s), 2) AS average_score, round(100.0*count(*) FILTER (WHERE quality=1)/count(*), 2) AS success_rate_pct,
 count(*) FILTER (WHERE s>=90) AS excellent, count(*) FILTER (WHERE s>=70 AND s<90) AS good, count(*) FILTER (WHERE s>=50 AND s<70) AS fair, count(*) FILTER (WHERE s<50) AS poor
FROM (SELECT lang, quality, n_chars%101 AS s FROM labels JOIN documents USING (doc_id)) GROUP BY lang""")
def _(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return op.score_summary(j.withColumn("s", F.col("n_chars") % 101), "lang", "s", F.col("quality") == 1)


_CUT = "TIMESTAMP '2024-01-15'"


@query("run_diff", f"""
WITH b AS (SELECT * FROM events WHERE ts<{_CUT}), a AS (SELECT * FROM events)
SELECT (SELECT count(*) FROM b) AS events_start, (SELECT count(*) FROM a) AS events_end, (SELECT count(DISTINCT user_id) FROM b) AS urls_start,
 (SELECT count(DISTINCT user_id) FROM a) AS urls_end, (SELECT count(*) FROM a)-(SELECT count(*) FROM b) AS new_events,
 (SELECT count(DISTINCT user_id) FROM a)-(SELECT count(DISTINCT user_id) FROM b) AS new_urls,
 CAST(floor(epoch((SELECT max(ts) FROM a))) - floor(epoch((SELECT max(ts) FROM b))) AS BIGINT) AS elapsed_sec""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "ts")
    return op.run_diff(e.filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")), e, "user_id", "ts")


@query("manual_review_summary", """
WITH l AS (SELECT CASE WHEN doc_id%5=0 THEN '' WHEN doc_id%5=1 THEN 'maybe' WHEN quality=1 THEN 'Yes' ELSE '0' END AS v, toxic=0 AS truth FROM labels)
SELECT count(*) AS rows, count(*) FILTER (WHERE v IN ('Yes','0')) AS completed, count(*) FILTER (WHERE v='') AS missing, count(*) FILTER (WHERE v='maybe') AS unknown,
 count(*) FILTER (WHERE v='Yes') AS true_rows, count(*) FILTER (WHERE v='0') AS false_rows,
 round(100.0*count(*) FILTER (WHERE v IN ('Yes','0') AND (v='Yes')=truth)/count(*) FILTER (WHERE v IN ('Yes','0')), 2) AS correct_pct FROM l""")
def _(spark, d):
    k = F.col("doc_id") % 5
    v = F.when(k == 0, "").when(k == 1, "maybe").when(F.col("quality") == 1, "Yes").otherwise("0")
    l = table(spark, d, "labels").withColumn("v", v)
    return op.review_summary(l, F.col("v"), F.col("toxic") == 0)


@query("latency_summary", """
WITH e AS (SELECT event_type, CASE WHEN event_id%50<>0 THEN value END AS v FROM events)
SELECT event_type, count(*) AS attempts, count(*)-count(v) AS failures, round(avg(v), 4) AS avg, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95,
 min(v) AS min, max(v) AS max, round(100.0*count(*) FILTER (WHERE v<=15)/count(v), 2) AS within_limit_pct FROM e GROUP BY event_type""")
def _(spark, d):
    return op.latency_summary(table(spark, d, "events"), "event_type", "value", F.col("event_id") % 50 == 0, 15.0)


@query("latency_summary_sketch")
def _(spark, d):
    return op.latency_summary(table(spark, d, "events"), "event_type", "value", F.col("event_id") % 50 == 0, 15.0, exact=False)


@query("block_triage", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_type, count(DISTINCT user_id) AS unique_urls, count(*) AS attempts, min(user_id) AS sample_url
FROM events WHERE event_type IN ('error','view') GROUP BY 1, 2""")
def _(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("error", "view"))
    e = e.withColumn("run", F.to_date("ts").cast("string"))
    return op.block_triage(e, ["run", "event_type"], "user_id")


def _monthly(spark, d):
    o = _orders(spark, d).withColumn("run", F.trunc("d", "month"))
    g = o.groupBy("run").agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("filled"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"), F.countDistinct("o_custkey").cast("double").alias("customers"),
    )
    return g.unpivot(["run"], ["orders", "filled", "urgent", "customers"], "metric", "value")


_MON = f"""{ORD}, mon AS (SELECT date_trunc('month', d) AS run, CAST(count(*) AS DOUBLE) AS orders, CAST(count(*) FILTER (WHERE o_orderstatus='F') AS DOUBLE) AS filled,
 CAST(count(*) FILTER (WHERE o_orderpriority='1-URGENT') AS DOUBLE) AS urgent, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS customers FROM o GROUP BY 1),
 obs AS (UNPIVOT mon ON orders, filled, urgent, customers INTO NAME metric VALUE value)"""


@query("kpi_scorecard", f"""
WITH {_MON}, t AS (SELECT run, orders*0.45+filled*0.30+urgent*0.15+customers*0.10 AS s FROM mon)
SELECT CAST(CAST(run AS DATE) AS VARCHAR) AS run, round(s, 4) AS total_score, round(coalesce(avg(s) OVER w, 0), 4) AS baseline FROM t
WINDOW w AS (ORDER BY run RANGE BETWEEN INTERVAL 62 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def _(spark, d):
    k = op.kpi_scorecard(_monthly(spark, d), {"orders": 0.45, "filled": 0.30, "urgent": 0.15, "customers": 0.10}, 62)
    return k.select(F.col("run").cast("string").alias("run"), F.round("total_score", 4).alias("total_score"), F.round(F.coalesce("baseline", F.lit(0.0)), 4).alias("baseline"))


@query("run_delta", f"""
WITH {_MON}, l AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY run) AS p FROM obs)
SELECT metric, CAST(CAST(run AS DATE) AS VARCHAR) AS run, value, coalesce(value-p, 0) AS delta,
 CASE WHEN p IS NULL THEN 'new' WHEN value=p THEN 'unchanged' WHEN (value>p)=(metric<>'urgent') THEN 'improved' ELSE 'regressed' END AS direction FROM l""")
def _(spark, d):
    obs = _monthly(spark, d)
    defs = obs.select("metric").distinct().withColumn("higher_is_better", F.col("metric") != "urgent")
    r = op.run_delta(obs, defs)
    return r.select("metric", F.col("run").cast("string").alias("run"), "value", F.coalesce("delta", F.lit(0.0)).alias("delta"), "direction")


@query("coverage_summary", """
WITH h AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal>9900), p AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal>8000)
SELECT count(*) AS watched, round(100.0*count(*) FILTER (WHERE n_nationkey IN (SELECT k FROM h))/count(*), 2) AS hit_pct,
 round(100.0*count(*) FILTER (WHERE n_nationkey IN (SELECT k FROM p))/count(*), 2) AS capture_pct,
 round(100.0*count(*) FILTER (WHERE n_regionkey=2 AND n_nationkey IN (SELECT k FROM h))/count(*) FILTER (WHERE n_regionkey=2), 2) AS priority_hit_pct FROM nation""")
def _(spark, d):
    watch = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") == 2).alias("priority"))
    crawled = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    captured = table(spark, d, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("k"))
    return op.coverage_summary(watch, crawled, captured, "k")


@query("relevance_counts", f"""
WITH {LOG} SELECT source, relevant, count(*) AS n FROM log WHERE source ILIKE '%I%' GROUP BY 1, 2""")
def _(spark, d):
    return crawl_log(spark, d).filter(F.col("source").ilike("%I%")).groupBy("source", "relevant").agg(F.count(F.lit(1)).alias("n"))


@query("crawl_tuning", """
WITH t AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type='error') AS e, count(*) FILTER (WHERE event_type='error' AND value>40) AS b FROM events GROUP BY 1),
r AS (SELECT user_id, n>=60 AND e/n>=0.22 AS slow, n>=60 AND e/n<=0.18 AND e/n<=0.08 AS fast, n>=60 AND b/n<=0.02 AS calm, b/n>=0.08 AS tense, e/n AS tr, b/n AS br FROM t)
SELECT user_id, round(tr, 4) AS timeout_ratio, round(br, 4) AS blocked_ratio, CASE WHEN slow THEN 40 ELSE 50 END AS new_timeout_sec, CASE WHEN slow THEN 1 ELSE 2 END AS new_retries,
 CASE WHEN slow THEN 6 WHEN fast THEN 10 ELSE 8 END AS new_concurrency, CASE WHEN slow THEN 1 WHEN fast THEN 3 ELSE 2 END AS new_per_domain,
 CASE WHEN calm THEN 4000 WHEN tense THEN 6000 ELSE 5000 END AS new_wait_min_ms, CASE WHEN calm THEN 13500 WHEN tense THEN 16500 ELSE 15000 END AS new_wait_max_ms FROM r""")
def _(spark, d):
    err = F.col("event_type") == "error"
    t = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(err).alias("timeouts"), F.count_if(err & (F.col("value") > 40)).alias("blocks"),
    ).withColumns({
        "checks": F.col("requests"), "breaker_triggers": F.lit(0), "strikes": F.lit(0), "timeout_sec": F.lit(50), "retries": F.lit(2),
        "concurrency": F.lit(8), "per_domain": F.lit(2), "wait_min_ms": F.lit(5000), "wait_max_ms": F.lit(15000),
    })
    return op.crawl_tuning(t, 60, 60).select(
        "user_id", "timeout_ratio", "blocked_ratio", "new_timeout_sec", "new_retries", "new_concurrency", "new_per_domain",
        "new_wait_min_ms", "new_wait_max_ms",
    )


@query("integrity_counts", f"""
WITH {ADDR}, a AS (SELECT *, CASE WHEN address_id%9=0 THEN city ELSE building_name||', '||city END AS fa FROM addr WHERE address_id%10<>0),
f AS (SELECT CASE WHEN o_orderkey%6<>0 THEN o_custkey END AS k FROM orders)
SELECT (SELECT count(*) FROM f) AS fact_rows, (SELECT count(k) FROM f) AS with_key, (SELECT min(k) FROM f) AS min_key, (SELECT max(k) FROM f) AS max_key,
 (SELECT count(*) FROM f WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE address_id=k)) AS broken_refs, (SELECT count(*) FROM a) AS dim_rows,
 (SELECT count(*) FROM a WHERE NOT starts_with(fa, building_name)) AS name_not_leading""")
def _(spark, d):
    a = customer_address(spark, d).filter("address_id % 10 <> 0").withColumn(
        "fa", F.when(F.col("address_id") % 9 == 0, F.col("city")).otherwise(F.concat_ws(", ", "building_name", "city"))
    )
    f = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey")).alias("k"))
    return op.integrity_counts(f, a, "k", "address_id", "building_name", "fa")


def limits_over(metrics):
    """Thresholds by metric: a floor for counts, a ceiling for urgent orders."""
    return metrics.select("metric").distinct().select(
        "metric", F.when(F.col("metric") == "urgent", "max").otherwise("min").alias("direction"),
        F.when(F.col("metric") == "urgent", 40.0).when(F.col("metric") == "filled", 60.0).otherwise(100.0).alias("threshold"),
    )


_LIM = "(CASE metric WHEN 'urgent' THEN value>40 WHEN 'filled' THEN value<60 ELSE value<100 END)"


@query("guardrails", f"WITH {_MON} SELECT metric, CAST(CAST(run AS DATE) AS VARCHAR) AS run, value FROM obs WHERE {_LIM}")
def _(spark, d):
    obs = _monthly(spark, d)
    return op.guardrails(obs, limits_over(obs)).select("metric", F.col("run").cast("string").alias("run"), "value")


@query("promotion_gate", f"""
WITH {_MON} SELECT CAST(CAST(run AS DATE) AS VARCHAR) AS run, bool_and(NOT {_LIM}) AS promote, count(*) FILTER (WHERE {_LIM}) AS failed_checks FROM obs GROUP BY 1""")
def _(spark, d):
    obs = _monthly(spark, d)
    bad = op.guardrails(obs, limits_over(obs)).select(F.col("metric").alias("m"), F.col("run").alias("r"))
    checks = obs.join(bad, (obs["metric"] == bad["m"]) & (obs["run"] == bad["r"]), "left").withColumn("passed", F.col("m").isNull())
    return op.promotion_gate(checks, ["run"]).withColumn("run", F.col("run").cast("string"))
