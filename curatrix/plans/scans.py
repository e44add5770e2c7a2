"""Scans and sinks over the benchmark data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintain
from ..sources import readers as rd
from ..sources import sinks
from ..sources.adapters import ev, table
from .common import EV, ORD
from .registry import query


@query("read_events", f"WITH {EV} SELECT event_id, CAST(start_date AS VARCHAR) AS start_date, start_sec, end_sec, event_type, place, true AS name_is_null FROM ev")
def _(spark, d):
    folder = sink_folder(spark, "event-table")
    e = ev(spark, d)
    e.select("event_id", "start_date", "start_sec", "end_sec", "event_type", F.col("place").alias("address_id"), F.col("ts").alias("time_stamp"), F.col("value").alias("spare")).write.parquet(folder)
    stored = rd.read_events(spark, folder)
    return stored.select("event_id", F.col("start_date").cast("string").alias("start_date"), "start_sec", "end_sec", "event_type", F.col("address_id").alias("place"), F.col("event_name").isNull().alias("name_is_null"))


@query("read_seeds", """
SELECT DISTINCT o_orderpriority AS source, k AS keyword, 'https://h'||CAST(o_custkey AS VARCHAR)||'.org' AS link FROM orders, (VALUES ('salsa'), ('tango')) v(k) WHERE o_custkey%3<>0""")
def _(spark, d):
    raw = table(spark, d, "orders").select(
        F.concat(F.lit("\ufeff"), F.col("o_orderpriority")).alias("source"), F.lit("salsa , tango").alias("keywords"),
        F.when(F.col("o_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" https://h"), F.col("o_custkey").cast("string"), F.lit(".org"))).alias("link"),
    )
    return rd.explode_seeds(raw)


@query("read_delete_audit", """
SELECT event_id, event_type AS deletion_reason, 'u'||CAST(user_id AS VARCHAR) AS url, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events WHERE event_id%10<>0""")
def _(spark, d):
    e = table(spark, d, "events")
    body = F.to_json(F.struct(
        F.col("ts").cast("string").alias("deleted_at_utc"), F.lit("db.dedup").alias("deletion_source"), F.col("event_type").alias("deletion_reason"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("extra_context"),
        F.struct("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url")).alias("event"),
    ))
    lines = e.select(F.when(F.col("event_id") % 20 == 0, "").when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), body)).otherwise(body).alias("value"))
    a = rd.parse_delete_audit(lines)
    return a.select(F.col("event.event_id").alias("event_id"), "deletion_reason", F.col("event.url").alias("url"), F.col("extra_context")["k"].alias("k"))


def step_lines(spark, d):
    """Log lines rebuilt from the event stream."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 5
    what = (
        F.when(k == 0, "query_llm(): querying openai model=gpt-x").when(k == 1, "query_llm(): OpenAI response received")
        .when(k == 2, "query_llm(): Mistral query failed: Read timed out").when(k == 3, "query_llm(): Gemini query failed: status 429").otherwise("db: wrote rows")
    )
    return e.select("event_id", F.concat_ws(" ", F.substring(F.col("ts").cast("string"), 1, 19), F.concat(F.lit("[run_id=r"), F.to_date("ts").cast("string"), F.lit("]")),
                    F.concat(F.lit("[step="), "event_type", F.lit("]")), what).alias("value"))


@query("parse_step_logs", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'r'||CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_type AS step,
 CASE event_id%5 WHEN 0 THEN 'openai' WHEN 1 THEN 'openai' WHEN 2 THEN 'mistral' WHEN 3 THEN 'gemini' ELSE '' END AS provider, CASE WHEN event_id%5=0 THEN 'gpt-x' ELSE '' END AS model,
 CASE event_id%5 WHEN 1 THEN 'success' WHEN 2 THEN 'failure' WHEN 3 THEN 'failure' ELSE '-' END AS outcome FROM events""")
def _(spark, d):
    p = rd.parse_step_logs(step_lines(spark, d))
    return p.select(F.col("ts").cast("string").alias("ts"), "run_id", "step", "provider", "model", F.coalesce("outcome", F.lit("-")).alias("outcome"))


@query("latest_run_slice", f"""
WITH {ORD}, l AS (SELECT o_orderpriority AS step, max(strftime(d, '%Y-%m')) AS run_id FROM o GROUP BY 1) SELECT o_orderkey FROM o JOIN l ON o_orderpriority=step AND strftime(d, '%Y-%m')=run_id""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("step"), F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.col("o_orderdate").alias("ts"))
    return rd.latest_run_slice(o).select("o_orderkey")


@query("read_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def _(spark, d):
    return rd.read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("n"))


@query("explode_ical_feeds", """
SELECT user_id AS feed, 'e'||CAST(event_id AS VARCHAR) AS uid, event_type||', big; show' AS summary, strftime(ts, '%Y%m%dT%H%M%S') AS dtstart, 'line '||CAST(event_id AS VARCHAR)||chr(10)||'two' AS description FROM events""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("slot", F.floor(F.col("event_id") / 20))
    block = F.concat(
        F.lit("BEGIN:VEVENT\r\nUID:e"), F.col("event_id").cast("string"), F.lit("\r\nSUMMARY;LANGUAGE=en:"), F.col("event_type"), F.lit("\\, big\r\n \\; show\r\nDTSTART;TZID=X:"),
        F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("\r\nDESCRIPTION:line "), F.col("event_id").cast("string"), F.lit("\\ntwo\r\nEND:VEVENT\r\n"),
    )
    # a feed holds the events of one user in one slot of twenty ids
    feeds = e.groupBy(F.col("user_id").alias("feed"), "slot").agg(F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.collect_list(block), ""), F.lit("END:VCALENDAR")).alias("value"))
    return rd.explode_ical(feeds).select("feed", "uid", "summary", "dtstart", "description")


@query("flatten_calendar_items", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'class, social dance' WHEN 'click' THEN 'workshop' ELSE 'other' END AS event_type, dayname(ts) AS day_of_week, CAST(CAST(ts AS DATE) AS VARCHAR) AS start_date,
 CASE WHEN event_id%2=0 THEN strftime(ts, '%H:%M:%S') ELSE 'none' END AS start_time, CAST(floor(value) AS INTEGER) AS price, 'cost $'||CAST(CAST(floor(value) AS INTEGER) AS VARCHAR)||' it''s '||event_type AS description FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    day = F.to_date("ts").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-08:00'")
    name = F.when(F.col("event_type") == "view", "Dance Class").when(F.col("event_type") == "click", "big WEEKEND").otherwise("show")
    side = F.struct(F.when(F.col("event_id") % 2 != 0, day).alias("date"), F.when(F.col("event_id") % 2 == 0, stamp).alias("dateTime"))
    items = e.select("event_id", F.struct(
        F.lit("https://c.org").alias("htmlLink"), name.alias("summary"), F.lit("Hall").alias("location"),
        F.concat(F.lit("<p>cost  $"), F.floor("value").cast("int").cast("string"), F.lit("</p><b>it&#39;s</b> "), "event_type").alias("description"), side.alias("start"), side.alias("end")).alias("item"))
    f = rd.flatten_calendar(items)
    return f.select("event_id", "event_type", "day_of_week", F.col("start_date").cast("string").alias("start_date"), F.coalesce("start_time", F.lit("none")).alias("start_time"), "price", "description")



@query("export_source_events", "SELECT event_id, user_id, value FROM events WHERE event_type='signup'")
def _(spark, d):
    out = sink_folder(spark, "export")
    sinks.export_events(table(spark, d, "events").select("event_id", "user_id", "value", "event_type"), "event_type", "signup", out, "2024-01-31 00:00:00")
    return sinks.import_events(spark, out, "event_id bigint, user_id bigint, value double, event_type string, time_stamp string").select("event_id", "user_id", "value")


def sink_folder(spark, name: str) -> str:
    """A fresh folder in the job's shared space (the checkpoint folder on a cluster)."""
    import uuid

    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


@query("publish_tables", """
SELECT 'events' AS "table", count(*) AS written_rows, count(*) AS expected_rows FROM events UNION ALL SELECT 'messages', count(*), count(*) FROM conversations""")
def _(spark, d):
    e = table(spark, d, "events")
    gate = e.agg((F.count(F.lit(1)) > 0).alias("promote"))
    return sinks.publish_tables(spark, {"events": e, "messages": table(spark, d, "conversations")}, sink_folder(spark, "publish"), gate)


@query("sync_window", """
SELECT event_id, CASE WHEN ts>=TIMESTAMP '2024-01-24' THEN value ELSE -1 END AS value FROM events WHERE event_id%3<>0 OR ts>=TIMESTAMP '2024-01-24'""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "value")
    target = e.filter("event_id % 3 <> 0").withColumn("value", F.lit(-1.0))
    return maintain.sync_window(e, target, "ts", ["event_id"], 7, F.lit("2024-01-31").cast("date")).select("event_id", "value")
