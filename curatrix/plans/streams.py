"""Streaming jobs run over the event stream until it is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy as fz
from ..operators import writing
from ..sources.adapters import as_events, table
from ..streaming import jobs
from .common import EV
from .maintenance import _day, candidates, write_addresses
from .registry import query
from .scans import sink_folder


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(d)
    return raw.withColumn("ts", jobs.to_instant(F.col("ts")))


def _run(spark, stream, schema, name):
    target = sink_folder(spark, name)
    jobs.run_to_table(stream, target, sink_folder(spark, name + "-state"))
    return jobs.read_result(spark, target, schema)


@query("domain_breaker", """
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS domain, ts, event_type<>'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type<>'error') AS rn FROM events),
s(domain, rn, ts, recent, open_until, fired) AS (
 SELECT DISTINCT domain, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST([] AS TIMESTAMP[]), CAST(NULL AS TIMESTAMP), false FROM e
 UNION ALL
 SELECT domain, rn, ts, recent, CASE WHEN fire THEN ts + INTERVAL 600 SECOND ELSE held END, fire FROM (
  SELECT *, NOT ok AND len(recent)>=3 AND (held IS NULL OR ts + INTERVAL 600 SECOND > held) AS fire FROM (
   SELECT domain, rn, ts, ok, held, CASE WHEN ok THEN [] ELSE list_append(list_filter(before, lambda t: t >= ts - INTERVAL 86400 SECOND), ts) END AS recent FROM (
    SELECT e.domain, e.rn, e.ts, e.ok, CASE WHEN s.open_until IS NOT NULL AND e.ts >= s.open_until THEN CAST([] AS TIMESTAMP[]) ELSE s.recent END AS before,
     CASE WHEN s.open_until IS NULL OR e.ts < s.open_until THEN s.open_until END AS held FROM s JOIN e ON e.domain=s.domain AND e.rn=s.rn+1))))
SELECT domain, epoch_us(ts) AS opened_us, epoch_us(open_until) AS until_us, CAST(len(recent) AS INTEGER) AS failures FROM s WHERE fired""")
def _(spark, d):
    # every event but an error is a success
    s = _stream(spark, d).select(F.col("user_id").cast("string").alias("domain"), "ts", (F.col("event_type") != "error").alias("ok"))
    out = _run(spark, jobs.domain_breaker(s, 3, 86400, 600), jobs.BREAKER_OUT, "breaker")
    return out.select("domain", F.unix_micros("opened_at").alias("opened_us"), F.unix_micros("until").alias("until_us"), "failures")


@query("adaptive_cooldown", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS scope, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events WHERE event_type='error')
SELECT scope, CAST(rn AS INTEGER) AS strikes, CAST(least(21600, 300*pow(2, rn-1)) AS BIGINT) AS cooldown_sec FROM e""")
def _(spark, d):
    # all other events are successes, which clear the count of failures but not the strikes
    s = _stream(spark, d).select(F.col("user_id").cast("string").alias("scope"), "ts", (F.col("event_type") != "error").alias("ok"))
    return _run(spark, jobs.adaptive_cooldown(s, failures=1), jobs.COOLDOWN_OUT, "cooldown").select("scope", "strikes", "cooldown_sec")


@query("first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    s = _stream(spark, d).select("user_id", "event_type", "ts")
    return _run(spark, jobs.first_seen(s, ["user_id", "event_type"], "ts", "60 days"), "user_id bigint, event_type string, ts timestamp", "seen").select("user_id", "event_type")


@query("stream_step_counts", """
SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events
GROUP BY 1, 2, time_bucket(INTERVAL 15 MINUTE, ts) HAVING time_bucket(INTERVAL 15 MINUTE, ts)+INTERVAL 15 MINUTE <= date_trunc('millisecond', (SELECT max(ts) FROM events))-INTERVAL 1 HOUR""")
def _(spark, d):
    s = jobs.step_counts(_stream(spark, d), "ts", "event_type")
    out = _run(spark, s, "window_start timestamp, window_end timestamp, event_type string, n bigint", "counts")
    return out.select(F.col("window_start").cast("string").alias("window_start"), "event_type", "n")


@query("stream_session_counts", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events),
c AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
a AS (SELECT user_id, count(*) AS n, max(ts)+INTERVAL 2 HOUR AS e FROM c GROUP BY user_id, sid)
SELECT user_id, n, count(*) AS sessions FROM a WHERE e <= date_trunc('millisecond', (SELECT max(ts) FROM events))-INTERVAL 1 HOUR GROUP BY 1, 2""")
def _(spark, d):
    s = jobs.session_counts(_stream(spark, d), "ts", "user_id", "2 hours")
    out = _run(spark, s, "session_start timestamp, session_end timestamp, user_id bigint, n bigint", "sessions")
    return out.groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))


@query("stream_write", f"""
WITH {EV} SELECT event_id AS row_id, place AS address_id FROM ev WHERE event_id%11<>0 AND event_id%13<>0 AND start_date>=DATE '2024-01-31'-20""")
def _(spark, d):
    addr = write_addresses(spark, d)
    rules = writing.WriteRules(_day("2024-01-31"), 20, scores=fz.lev_scores, ratio=fz.lev_ratio)

    def write(batch, known):
        batch = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        accepted, _, fresh, _ = writing.write_events(candidates(as_events(batch)), known, rules)
        return accepted, fresh

    target = sink_folder(spark, "written")
    jobs.stream_write(_stream(spark, d), write, target, sink_folder(spark, "written-state"), addr, ["row_id"]).awaitTermination()
    return jobs.current_rows(spark, target).select("row_id", "address_id")
