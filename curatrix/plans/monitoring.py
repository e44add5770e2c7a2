"""Monitoring queries: trends, activity, audits, gates and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy as fz
from ..operators import metrics as op
from ..operators import replay
from ..sources import readers as rd
from ..sources.adapters import table
from .common import ORD
from .metrics import _as_of
from .registry import query
from .scans import step_lines


_HIST = f"""{ORD}, h AS (SELECT strftime(d, '%Y-%m') AS run_id, o_orderpriority||CAST(o_custkey%3 AS VARCHAR) AS source, count(*) AS c FROM o GROUP BY 1, 2),
 rr AS (SELECT DISTINCT run_id FROM h WHERE run_id<>'2000-07' ORDER BY run_id DESC LIMIT 14), b AS (SELECT source, avg(c) AS a FROM h WHERE run_id IN (SELECT run_id FROM rr) GROUP BY 1 HAVING avg(c)>=5 ORDER BY a DESC, source LIMIT 10),
 j AS (SELECT source, a, coalesce((SELECT c FROM h WHERE run_id='2000-07' AND h.source=b.source), 0) AS cur FROM b)"""


@query("source_trend_alerts", f"""
WITH {_HIST}, k AS (SELECT *, (cur-a)/greatest(1.0, a) AS p FROM j) SELECT source, round(a, 4) AS baseline_avg, cur AS current_count,
 CASE WHEN cur=0 THEN 'dropout' WHEN p<=-0.15 THEN 'drop' WHEN p>=0.15 THEN 'spike' END AS alert_type FROM k WHERE cur=0 OR p<=-0.15 OR p>=0.15""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.concat(F.col("o_orderpriority"), (F.col("o_custkey") % 3).cast("string")).alias("source"))
    h = o.groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("event_count")).withColumn("run_ts", F.col("run_id"))
    a = op.source_alerts(h, "2000-07", drop=0.15, spike=0.15)
    return a.select("source", F.round("baseline_avg", 4).alias("baseline_avg"), "current_count", "alert_type")


_PR = """pr AS (SELECT CASE event_id%5 WHEN 0 THEN 'openai' WHEN 1 THEN 'openai' WHEN 2 THEN 'mistral' WHEN 3 THEN 'gemini' END AS provider, event_id%5 AS k FROM events
  WHERE event_id%5<>4 AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'),
 pa AS (SELECT provider, count(*) FILTER (WHERE k=0) AS attempts, count(*) FILTER (WHERE k=1) AS successes, count(*) FILTER (WHERE k IN (2,3)) AS failures,
  count(*) FILTER (WHERE k=2) AS timeouts, count(*) FILTER (WHERE k=3) AS rate_limits FROM pr GROUP BY 1)"""


def _providers(spark, d):
    lines = rd.parse_step_logs(step_lines(spark, d))
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10 00:00:00", "2024-01-20 00:00:00"))
    return op.provider_activity(lines, lo, hi)


@query("provider_activity", f"WITH {_PR} SELECT * FROM pa")
def _(spark, d):
    return _providers(spark, d)


@query("pressure_level", f"""
WITH {_PR}, t AS (SELECT sum(attempts) AS attempts, sum(timeouts) AS timeouts, sum(rate_limits) AS rate_limits FROM pa) SELECT CAST(attempts AS BIGINT) AS attempts,
 CASE WHEN attempts>=150 OR timeouts>=15 OR rate_limits>=25 THEN 'HIGH' WHEN attempts>=60 OR timeouts>=5 OR rate_limits>=10 THEN 'MEDIUM' ELSE 'LOW' END AS pressure_level FROM t""")
def _(spark, d):
    t = _providers(spark, d).agg(
        F.sum("attempts").alias("attempts"), F.sum("timeouts").alias("timeouts"), F.sum("rate_limits").alias("rate_limits"), F.lit(0).alias("exhausted"),
        F.coalesce(F.sum(F.when(F.col("provider") == "gemini", F.col("attempts"))), F.lit(0)).alias("fallback_attempts"))
    return op.pressure_level(t).select("attempts", "pressure_level")


@query("alias_audit", """
WITH a AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS decision, CASE WHEN user_id%3=0 THEN '(blank)' ELSE 'r'||CAST(user_id%3 AS VARCHAR) END AS rule, 'c'||CAST(user_id%7 AS VARCHAR) AS cand FROM events),
 k AS (SELECT * FROM a WHERE day IN (SELECT DISTINCT day FROM a ORDER BY day DESC LIMIT 5))
SELECT CASE WHEN grouping(day)=0 THEN 'daily' WHEN grouping(cand)=0 THEN 'candidate' WHEN grouping(rule)=0 THEN 'rule_decision' ELSE 'decision' END AS facet,
 coalesce(day, cand, CASE WHEN grouping(rule)=0 THEN rule||' | '||decision END, decision) AS key, count(*) AS n FROM k GROUP BY GROUPING SETS ((day), (decision), (rule, decision), (cand))""")
def _(spark, d):
    e = table(spark, d, "events")
    a = e.select(
        "ts", F.col("event_type").alias("decision"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string"))).alias("rule_name"),
        F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("candidate"))
    return op.alias_audit(a, 5)


_SD = """s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey%6 AS k, CASE WHEN o_custkey%5=0 THEN 3 ELSE 48 END AS age, CAST(80+o_custkey%20 AS BIGINT) AS fz FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-01-01'-14 AND DATE '2001-01-01'),
 c AS (SELECT *, CASE WHEN k=0 THEN 2 ELSE 0 END AS s1, CASE WHEN k=1 AND fz<90 THEN 2 ELSE 0 END AS s2, CASE WHEN k=2 THEN 3 ELSE 0 END AS s3, CASE WHEN k=3 THEN 3 ELSE 0 END AS s4,
  CASE WHEN k=4 THEN 2 ELSE 0 END AS s5, CASE WHEN age<=6 THEN 1 ELSE 0 END AS s7 FROM s), t AS (SELECT *, s1+s2+s3+s4+s5+s7 AS score FROM c)"""


@query("suspicious_deletes", f"""
WITH {_SD} SELECT o_orderkey AS event_id, score AS suspicion_score, CASE WHEN k=2 THEN 'future_event_deleted_by_cleanup' WHEN s1>0 THEN 'model_driven_delete_requires_review' WHEN s2>0 THEN 'low_confidence_fuzzy_duplicate'
 WHEN s4>0 THEN 'local_looking_location_deleted_as_non_local' WHEN s5>0 THEN 'non_empty_event_deleted_as_empty_dud' ELSE 'rapid_post_ingest_delete' END AS category
FROM t WHERE score>=2 AND NOT ((k=5 OR (k=1 AND fz>=90)) AND score<4) ORDER BY score DESC, d, o_orderkey LIMIT 40""")
def _(spark, d):
    k = F.col("o_orderkey") % 6
    a = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("deleted_at"),
        F.when(k == 0, "dedup_llm.delete_duplicates").when(k == 1, "db.fuzzy_duplicates").when(k == 2, "db.delete_old_events").when(k == 5, "db.dedup").otherwise("db.delete_likely_dud_events").alias("deletion_source"),
        F.when(k == 3, "outside_bc_filter").when(k == 4, "empty_source_dance_style_url_no_address").otherwise("x").alias("deletion_reason"),
        (F.col("o_custkey") % 20 + 80).alias("fuzzy_score"), F.lit("n").alias("event_name"), F.lit("u").alias("url"), F.lit("Hall, Victoria").alias("location"), F.lit("").alias("dance_style"), F.lit("").alias("description"),
        F.when(k == 2, F.lit("2001-06-01")).otherwise(F.lit("2000-01-01")).cast("date").alias("start_date"),
        (F.col("o_orderdate").cast("timestamp_ntz") - F.when(F.col("o_custkey") % 5 == 0, F.expr("interval 3 hours")).otherwise(F.expr("interval 48 hours"))).alias("time_stamp"),
    )
    out = op.suspicious_deletes(a, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"), 14, 40)
    return out.select("event_id", "suspicion_score", "category")


_REL = """x AS (SELECT event_type, avg(value)+60 AS a, 1-count(*) FILTER (WHERE value>50)/count(*) AS e, count(*) AS n, count(*) FILTER (WHERE value>90) AS rl, count(*) FILTER (WHERE value>95) AS tm, count(*) FILTER (WHERE value>150)%5 AS ex FROM events GROUP BY 1),
 sc AS (SELECT *, greatest(0, least(100, 100 - greatest(0, least(20, 90-a)) - greatest(0, least(20, (1-e)*20)) - least(15, rl/n*100) - least(10, ex*2.0))) AS s FROM x)"""


def _scorecard(spark, d):
    v, one = F.col("value"), F.count(F.lit(1))
    g = table(spark, d, "events").groupBy("event_type").agg(
        (F.avg(v) + 60).alias("average_score"), (1 - F.count_if(v > 50) / one).alias("execution_rate"), one.alias("attempts"),
        F.count_if(v > 90).alias("rate_limits"), F.count_if(v > 95).alias("timeouts"), (F.count_if(v > 150) % 5).alias("exhausted"))
    return op.reliability_scorecard(g)


@query("reliability_scorecard", f"WITH {_REL} SELECT event_type, round(s, 1) AS score, CASE WHEN s>=85 THEN 'HEALTHY' WHEN s>=70 THEN 'WATCH' ELSE 'AT_RISK' END AS status FROM sc")
def _(spark, d):
    return _scorecard(spark, d).select("event_type", "score", "status")


_GR = f"""{_REL}, gr AS (SELECT event_type, 'score' AS gate, round(s, 1)>=75 AS ok FROM sc UNION ALL SELECT event_type, 'execution_rate', e>=0.90 FROM sc UNION ALL SELECT event_type, 'average_score', a>=70 FROM sc
 UNION ALL SELECT event_type, 'rate_limits', rl<=25 FROM sc UNION ALL SELECT event_type, 'timeouts', tm<=15 FROM sc UNION ALL SELECT event_type, 'exhausted', ex<=10 FROM sc)"""


@query("reliability_gates", f"WITH {_GR} SELECT event_type, gate, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM gr")
def _(spark, d):
    return op.gate_rows(_scorecard(spark, d), ["event_type"]).select("event_type", "gate", "status")


@query("issue_rows", f"""
WITH {_GR}, {_PR} SELECT 'GATE-'||upper(gate) AS issue_id, 'high' AS severity, count(*) AS n FROM gr WHERE NOT ok GROUP BY 1, 2
UNION ALL SELECT 'LLM-'||upper(provider)||'-001', CASE WHEN timeouts>0 OR rate_limits>0 THEN 'high' ELSE 'medium' END, 1 FROM pa WHERE failures>0 OR timeouts>0 OR rate_limits>0""")
def _(spark, d):
    issues = op.issue_rows(op.gate_rows(_scorecard(spark, d), ["event_type"]), _providers(spark, d))
    return issues.groupBy("issue_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("history_summary", f"""
WITH {ORD}, h AS (SELECT d, o_orderkey, o_totalprice AS s FROM o), l AS (SELECT arg_max(s, d*1.0) AS x FROM (SELECT epoch(d)*1000000+o_orderkey AS d, s FROM h))
SELECT w AS "window", count(*) FILTER (WHERE d>=DATE '2001-08-01'-n) AS runs, round(avg(s) FILTER (WHERE d>=DATE '2001-08-01'-n), 2) AS average_score, round((SELECT x FROM l), 2) AS latest_score,
 round((SELECT x FROM l)-avg(s) FILTER (WHERE d>=DATE '2001-08-01'-n), 2) AS delta_latest_vs_avg FROM h, (VALUES ('7d', 7), ('30d', 30)) v(w, n) GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("score"))
    return op.history_summary(o, _as_of("2001-08-01"))


@query("issue_registry", """
WITH p AS (SELECT event_type||':'||CAST(user_id AS VARCHAR) AS k, min(CAST(ts AS DATE)) AS f, max(CAST(ts AS DATE)) AS l, count(*) AS n FROM events WHERE ts<TIMESTAMP '2024-01-29' GROUP BY 1),
c AS (SELECT event_type||':'||CAST(user_id AS VARCHAR) AS k, min(CAST(ts AS DATE)) AS f, max(CAST(ts AS DATE)) AS l, count(*) AS n FROM events WHERE ts>=TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT coalesce(p.k, c.k) AS issue_key, CAST(least(p.f, c.f) AS VARCHAR) AS first_seen, CAST(greatest(p.l, c.l) AS VARCHAR) AS last_seen, coalesce(p.n, 0)+coalesce(c.n, 0) AS occurrence_count,
 CASE WHEN c.k IS NULL THEN 'closed' ELSE 'open' END AS status FROM p FULL JOIN c ON p.k=c.k""")
def _(spark, d):
    e = table(spark, d, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("issue_key"), F.to_date("ts").alias("seen_at"), "ts")
    cut = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    prev = e.filter(F.col("ts") < cut).groupBy("issue_key").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count(F.lit(1)).alias("occurrence_count"))
    r = op.issue_registry(prev, e.filter(F.col("ts") >= cut))
    return r.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


@query("issue_trends", f"""
WITH {ORD}, p AS (SELECT o_orderpriority, o_custkey, count(*) AS n, min(d) AS f FROM o GROUP BY 1, 2)
SELECT o_orderpriority, count(*) AS issues, max(n) AS max_occurrences, max(DATE '2001-08-01'-f) AS max_age_days, CAST(max(n)+least(max(DATE '2001-08-01'-f), 30)*0.25 AS DOUBLE) AS score FROM p GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_custkey", F.to_date("o_orderdate").alias("d"))
    return op.issue_trends(o, _as_of("2001-08-01"), "o_orderpriority", "o_custkey", "d").withColumn("score", F.col("score").cast("double"))


@query("action_queue", f"""
WITH {_GR}, u AS (SELECT 0 AS priority, 'Fix '||gate AS title, event_type AS reason FROM gr WHERE NOT ok UNION ALL SELECT 1, 'Fix '||event_type, 'recurring' FROM events WHERE value>100 UNION ALL SELECT 2, 'Fix score', 'tune' UNION ALL SELECT 2, 'Review '||event_type, 'tune' FROM events)
SELECT title, min(priority) AS priority FROM u GROUP BY 1 ORDER BY 2, 1 LIMIT 12""")
def _(spark, d):
    gates = op.gate_rows(_scorecard(spark, d), ["event_type"]).filter("status = 'FAIL'").select(F.concat(F.lit("Fix "), "gate").alias("title"), F.col("event_type").alias("reason"))
    e = table(spark, d, "events")
    again = e.filter("value > 100").select(F.concat(F.lit("Fix "), "event_type").alias("title"), F.lit("recurring").alias("reason"))
    recs = e.select(F.explode(F.array(F.lit("Fix score"), F.concat(F.lit("Review "), "event_type"))).alias("title"), F.lit("tune").alias("reason"))
    return op.action_queue([gates, again, recs], "title").select("title", "priority")


def _replay(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders").withColumn("d", F.to_date("o_orderdate"))
    site = F.when(c % 10 == 0, "https://www.facebook.com/h").otherwise("https://hall.org/h")
    url = F.concat(site, c.cast("string"))
    base = o.select(
        k.alias("base_id"), F.concat_ws(" ", F.lit("Show"), "o_orderpriority").alias("event_name"), F.col("d").cast("string").alias("start_date"), F.lit("19:30").alias("start_time"),
        F.col("o_orderstatus").alias("source"), F.lit("Hall A").alias("location"), F.when(k % 41 == 0, "").otherwise(url).alias("url"))
    cand = o.filter(c % 9 != 0).select(
        k.alias("cand_id"), url.alias("page_url"), F.when(k % 5 == 0, F.concat_ws(" ", F.lit("Show"), "o_orderpriority", F.lit("live"))).when(k % 5 == 1, "Completely other").otherwise(F.concat_ws(" ", F.lit("Show"), "o_orderpriority")).alias("event_name"),
        F.date_add("d", F.when(k % 4 == 0, 7).otherwise(0)).cast("string").alias("start_date"), F.when(k % 3 == 0, "7:30 AM").when(k % 3 == 1, "19:30:00").otherwise("20:00").alias("start_time"),
        F.when(k % 7 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("source"), F.when(k % 6 == 0, "Hall B").otherwise("Hall A").alias("location"),
        F.when(k % 13 == 0, F.concat(url, F.lit("/x"))).otherwise(url).alias("url"))
    status = table(spark, d, "customer").filter("c_custkey % 17 = 0").select(F.concat(F.when(F.col("c_custkey") % 10 == 0, "https://www.facebook.com/h").otherwise("https://hall.org/h"), F.col("c_custkey").cast("string")).alias("page_url"), F.lit(False).alias("ok"), F.lit("url_unreachable_replay").alias("category"))
    return base, cand, status


_RM = """b AS (SELECT o_orderkey AS bid, 'show '||lower(o_orderpriority) AS nm, CAST(o_orderdate AS DATE) AS d, 70200 AS t, lower(o_orderstatus) AS src, CASE WHEN o_orderkey%41=0 THEN '' ELSE CASE WHEN o_custkey%10=0 THEN 'https://www.facebook.com/h' ELSE 'https://hall.org/h' END||CAST(o_custkey AS VARCHAR) END AS url FROM orders),
 c AS (SELECT o_orderkey AS cid, CASE WHEN o_custkey%10=0 THEN 'https://www.facebook.com/h' ELSE 'https://hall.org/h' END||CAST(o_custkey AS VARCHAR) AS page,
  CASE o_orderkey%5 WHEN 0 THEN 'show '||lower(o_orderpriority)||' live' WHEN 1 THEN 'completely other' ELSE 'show '||lower(o_orderpriority) END AS nm, CAST(o_orderdate AS DATE)+CASE WHEN o_orderkey%4=0 THEN 7 ELSE 0 END AS d,
  CASE o_orderkey%3 WHEN 0 THEN 27000 WHEN 1 THEN 70200 ELSE 72000 END AS t, CASE WHEN o_orderkey%7=0 THEN 'z' ELSE lower(o_orderstatus) END AS src, CASE WHEN o_orderkey%6=0 THEN 'hall b' ELSE 'hall a' END AS loc, o_orderkey%13=0 AS off FROM orders WHERE o_custkey%9<>0),
 cu AS (SELECT *, min(cid) OVER w AS rep, count(*) OVER w AS copies FROM c WINDOW w AS (PARTITION BY page, nm, d, t, src, loc, off)),
 st AS (SELECT CASE WHEN c_custkey%10=0 THEN 'https://www.facebook.com/h' ELSE 'https://hall.org/h' END||CAST(c_custkey AS VARCHAR) AS page FROM customer WHERE c_custkey%17=0),
 p AS (SELECT b.*, cid, cu.nm AS cn, cu.d AS cd, cu.t AS ct, cu.src AS cs, loc, off, copies, 1-levenshtein(b.nm, cu.nm)/greatest(length(b.nm), length(cu.nm)) AS sim, contains(b.nm, cu.nm) OR contains(cu.nm, b.nm) AS va, abs(b.t-cu.t) IN (0, 43200) AS tok FROM b JOIN cu ON b.url=page AND cid=rep),
 q AS (SELECT *, CASE WHEN nm=cn THEN 4 ELSE 0 END+CASE WHEN d=cd THEN 4 ELSE 0 END+CASE WHEN NOT off THEN 3 ELSE 0 END+CASE WHEN src=cs THEN 2 ELSE 0 END+CASE WHEN t=ct THEN 2 ELSE 0 END AS sc,
  coalesce(sum(copies) FILTER (WHERE NOT off) OVER (PARTITION BY bid), 0) AS np, coalesce(max(CASE WHEN NOT off AND d=cd THEN 1 END) OVER (PARTITION BY bid), 0) AS hd, sum(copies) OVER (PARTITION BY bid) AS n,
  coalesce(sum(copies) FILTER (WHERE nm=cn AND d=cd AND t=ct) OVER (PARTITION BY bid), 0) AS ni, max(sim) OVER (PARTITION BY bid) AS ts, bool_or(va) OVER (PARTITION BY bid) AS av FROM p),
 z AS (SELECT *, CASE WHEN np>1 THEN NOT off AND (hd=0 OR d=cd) ELSE true END AS pool FROM q),
 y AS (SELECT *, bool_or(pool AND (sim>=0.75 OR va)) OVER (PARTITION BY bid) AS hs, bool_or(pool AND tok) OVER (PARTITION BY bid) AS ht FROM z),
 pk AS (SELECT * FROM y WHERE np<=1 OR (pool AND CASE WHEN hs THEN sim>=0.75 OR va WHEN ht THEN tok ELSE true END) QUALIFY row_number() OVER (PARTITION BY bid ORDER BY sc DESC, cid)=1),
 res AS (SELECT b.bid AS base_id, CASE WHEN b.url='' THEN 'missing_url_baseline' WHEN b.url IN (SELECT page FROM st) THEN 'url_unreachable_replay' WHEN cid IS NULL THEN 'no_event_extracted_replay'
  WHEN contains(b.url, 'facebook') AND off THEN 'wrong_replay_source_url' WHEN ni>1 THEN 'duplicate_event_identity' WHEN n>1 AND NOT off AND pk.d=cd AND ts<0.6 AND NOT av THEN 'wrong_replay_event_selection'
  WHEN NOT off AND pk.d=cd AND (sim>=0.9 OR va) AND tok THEN '' WHEN pk.d<>cd THEN 'wrong_date' WHEN pk.t<>ct THEN 'wrong_time' WHEN loc<>'hall a' THEN 'wrong_location_or_address' WHEN cs<>pk.src THEN 'wrong_source' WHEN sim<0.6 THEN 'content_drift_major' ELSE 'other_mismatch' END AS category
  FROM b LEFT JOIN pk ON b.bid=pk.bid)"""


@query("match_replay_native", f"WITH {_RM} SELECT base_id, category, category='' AS is_match FROM res")
def _(spark, d):
    base, cand, status = _replay(spark, d)
    return replay.match_replay(base, cand, status, similarity=lambda a, b: fz.lev_ratio(a, b) / 100).select("base_id", "category", "is_match")


@query("match_replay")
def _(spark, d):
    base, cand, status = _replay(spark, d)
    return replay.match_replay(base, cand, status)
