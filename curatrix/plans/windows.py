"""Window operators over the benchmark data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds
from ..operators import keyed
from ..operators import maintain
from ..operators import metrics
from ..operators import windows as op
from ..sources.adapters import customer_address, ev, table
from .common import ADDR, EV, ORD
from .registry import query


def _day(t):
    return F.lit(t).cast("date")


_G = """g AS (SELECT start_date, start_sec//900*900 AS s, end_sec//900*900 AS e, count(*) AS n FROM ev WHERE start_date>DATE '2024-01-02' GROUP BY 1, 2, 3 HAVING count(*)>1)"""


@query("quarter_hour_groups_exact", f"""
WITH {EV}, {_G} SELECT event_id, dense_rank() OVER (ORDER BY start_date, s, e) AS group_id FROM ev JOIN g USING (start_date) WHERE start_sec//60*60=s AND end_sec//60*60=e""")
def _(spark, d):
    return op.quarter_hour_groups(ev(spark, d), _day("2024-01-02")).select("event_id", "group_id")


@query("quarter_hour_groups_floored", f"""
WITH {EV}, {_G} SELECT event_id, dense_rank() OVER (ORDER BY start_date, s, e) AS group_id FROM ev JOIN g USING (start_date) WHERE start_sec//900*900=s AND end_sec//900*900=e""")
def _(spark, d):
    return op.quarter_hour_groups(ev(spark, d), _day("2024-01-02"), "floored").select("event_id", "group_id")


@query("latest_per_key", """
SELECT DISTINCT ON (CAST(ts AS DATE), user_id) CAST(CAST(ts AS DATE) AS VARCHAR) AS run, user_id, event_id, event_type FROM events ORDER BY CAST(ts AS DATE), user_id, ts DESC, event_id DESC""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("run", F.to_date("ts").cast("string"))
    return keyed.latest_per_key(e, ["run", "user_id"], ["ts", "event_id"]).select("run", "user_id", "event_id", "event_type")


@query("duplicate_address_groups", f"""
WITH {ADDR}, p AS (SELECT a.address_id AS x, b.address_id AS y FROM addr a JOIN addr b ON a.address_id<b.address_id AND
  ((a.street_number=b.street_number AND a.street_name=b.street_name) OR (a.nation_key%5=0 AND b.nation_key%5=0 AND a.city||a.province_or_state=b.city||b.province_or_state))),
c AS (SELECT x AS g, y AS address_id FROM p UNION SELECT x, x FROM p), f AS (SELECT min(g) AS g, address_id FROM c GROUP BY 2)
SELECT dense_rank() OVER (ORDER BY g) AS group_id, address_id FROM f""")
def _(spark, d):
    a = customer_address(spark, d).withColumn(
        "building_name", F.when(F.col("nation_key") % 5 == 0, F.concat("city", "province_or_state")).otherwise(" ")
    )
    return op.duplicate_address_groups(a, [["street_number", "street_name"], ["building_name"]])


@query("latest_observation", f"""
WITH {ORD} SELECT strftime(d, '%Y-%m') AS run_id, max(o_orderkey) AS last_key, arg_max(o_totalprice, o_orderkey) AS value FROM
 (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY strftime(d, '%Y-%m') ORDER BY d DESC, o_orderkey DESC)=1) GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), "o_orderdate", "o_orderkey", "o_totalprice")
    return keyed.latest_per_key(o, ["run_id"], ["o_orderdate", "o_orderkey"]).select(
        "run_id", F.col("o_orderkey").alias("last_key"), F.col("o_totalprice").alias("value")
    )


@query("failure_streak", """
WITH r AS (SELECT user_id, event_type IN ('purchase','signup') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn<=5)
SELECT user_id, coalesce(min(rn) FILTER (WHERE ok)-1, count(*)) AS streak, count(*) AS attempts FROM r GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ok", F.col("event_type").isin("purchase", "signup"))
    return op.failure_streak(e, "user_id", "ts", "ok", 5, "event_id")


@query("rank_in_run", f"""
WITH {ORD}, c AS (SELECT strftime(d, '%Y-%m') AS run_id, o_orderpriority AS source, count(*) AS event_count FROM o GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_count DESC, source) AS rank_in_run FROM c""")
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.col("o_orderpriority").alias("source")).agg(
        F.count(F.lit(1)).alias("event_count")
    )
    return op.rank_in_run(o, "run_id", "event_count", "source")


@query("latest_delete", """
WITH a AS (SELECT CASE WHEN user_id%7<>0 THEN user_id END AS k, ts, event_id AS n FROM events)
SELECT max(k) AS event_id, arg_max(n, ts) AS audit_no FROM a WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT k, n FROM a WHERE k IS NULL""")
def _(spark, d):
    e = table(spark, d, "events").select(
        F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("event_id"), F.col("ts").alias("deleted_at"), F.col("event_id").alias("audit_no")
    )
    return maintain.latest_delete(e).select("event_id", "audit_no")


@query("renumber_keys", """
WITH m AS (SELECT c_custkey AS old, row_number() OVER (ORDER BY c_custkey) AS new FROM customer WHERE c_custkey%3<>1)
SELECT o_orderkey, coalesce(new, o_custkey) AS o_custkey FROM orders LEFT JOIN m ON old=o_custkey""")
def _(spark, d):
    dim = table(spark, d, "customer").filter("c_custkey % 3 <> 1")
    mapping = maintain.renumber(dim, "c_custkey")
    return maintain.repoint(table(spark, d, "orders").select("o_orderkey", "o_custkey"), mapping, "o_custkey")


@query("domain_cap", """
SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id)<=7""")
def _(spark, d):
    return metrics.domain_cap(table(spark, d, "documents").select("source", "doc_id"), "source", [F.asc("doc_id")], 7).drop("rn")


@query("running_failures", """
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE event_type='error')
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM e""")
def _(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", epoch_seconds("ts").alias("s"))
    return op.trailing_count(e, "user_id", "s", 86400).select("event_id", "recent")
