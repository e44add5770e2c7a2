"""SQL fragments shared by the oracles, mirroring the adapter views."""

from __future__ import annotations

SEC = "(hour(ts)*3600+minute(ts)*60+second(ts))"
EV = f"""ev AS (SELECT event_id, CAST(ts AS DATE) AS start_date, CAST({SEC} AS BIGINT) AS start_sec,
 CAST(({SEC}+CAST(floor(value*60) AS BIGINT))%86400 AS BIGINT) AS end_sec, event_type, event_type AS source,
 user_id AS place, ts, value, props FROM events)"""
LOG = """log AS (SELECT 'u'||CAST(user_id AS VARCHAR) AS link, event_type IN ('purchase','signup') AS relevant,
 1 AS crawl_try, ts AS time_stamp, event_type AS source, event_id FROM events)"""
ADDR = """addr AS (SELECT c_custkey AS address_id, c_name AS building_name, CAST(c_custkey%500 AS VARCHAR) AS street_number,
 'Street '||CAST(c_custkey%37 AS VARCHAR) AS street_name, n_name AS city, r_name AS country_id,
 c_nationkey AS nation_key, c_mktsegment AS province_or_state
 FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)"""
ORD = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS d,
 o_orderpriority FROM orders)"""

URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(e: str, n: int) -> str:
    return f"regexp_extract(trim({e}), '{URL_RE}', {n})"


def scheme(e):
    return f"lower({part(e, 1)})"


def netloc(e):
    return f"lower({part(e, 2)})"


def path(e):
    return part(e, 3)


def qry(e):
    return part(e, 4)


def host(e):
    return f"regexp_replace({netloc(e)}, ':[0-9]*$', '')"


def with_query(e):
    return f"(CASE WHEN {qry(e)}<>'' THEN '?'||{qry(e)} ELSE '' END)"


def compare_key(e):
    return (
        f"(CASE WHEN {scheme(e)}='' THEN 'https' ELSE {scheme(e)} END||'://'||"
        f"CASE WHEN {scheme(e)}='http' THEN regexp_replace({netloc(e)}, ':80$', '') "
        f"ELSE regexp_replace({netloc(e)}, ':443$', '') END"
        f"||rtrim({path(e)}, '/')||{with_query(e)})"
    )


def label(e):
    """Second-level host label."""
    h = f"regexp_replace({host(e)}, '^www\\.', '')"
    return f"list_extract(string_split({h}, '.'), -2)"


def weekday(e):
    """Monday=0."""
    return f"(isodow({e})-1)"
