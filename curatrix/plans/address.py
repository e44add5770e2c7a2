"""Address resolution over the benchmark data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy as fz
from ..functions import text as tx
from ..operators import address as op
from ..operators import rules as rules_op
from ..sources.adapters import customer_address, table, wide
from .common import ADDR
from .registry import query


def _lev(a, b):
    return f"(1-levenshtein({a}, {b})/greatest(length({a}), length({b})))*100"


@query("match_street", f"""
WITH {ADDR}, x AS (SELECT o_orderkey, CAST(o_custkey%600 AS VARCHAR) AS n, 'Hall, '||CAST(o_custkey%600 AS VARCHAR)||' Street '||CAST(o_custkey%37 AS VARCHAR) AS loc FROM orders)
SELECT o_orderkey, min(address_id) AS address_id FROM x JOIN addr ON n=street_number AND contains(loc, street_name) GROUP BY 1""")
def _(spark, d):
    k = F.col("o_custkey")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Hall, "), (k % 600).cast("string"), F.lit(" Street "), (k % 37).cast("string")).alias("loc"))
    return op.match_street(o, customer_address(spark, d), "o_orderkey", "loc")


@query("alias_match", """
WITH r AS (SELECT n_nationkey AS ro, CASE WHEN n_nationkey%3=0 THEN 'supplier 0000000'||CASE WHEN n_nationkey<10 THEN '0' ELSE '' END||CAST(n_nationkey AS VARCHAR) WHEN n_nationkey%3=1 THEN 'supplier' ELSE '00000'||CAST(n_nationkey AS VARCHAR) END AS al,
  CASE WHEN n_nationkey%2=0 THEN '' ELSE '5' END AS num, n_nationkey*10 AS aid FROM nation),
s AS (SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS t, CAST(s_suppkey%10 AS VARCHAR) AS num FROM supplier),
e AS (SELECT s_suppkey, min(ro) AS ro FROM s JOIN r ON t=al GROUP BY 1), b AS (SELECT s_suppkey, min(ro) AS ro FROM s JOIN r ON contains(t, al) AND (length(al)>=10 OR contains(al, ' ')) GROUP BY 1)
SELECT s.s_suppkey, aid AS address_id, CASE WHEN e.ro IS NOT NULL THEN 'exact' ELSE 'substring' END AS match_type, CASE WHEN r.num<>'' AND r.num<>s.num THEN 'skipped_conflict' ELSE 'applied' END AS decision
FROM s LEFT JOIN e USING (s_suppkey) LEFT JOIN b USING (s_suppkey) JOIN r ON r.ro=coalesce(e.ro, b.ro)""")
def _(spark, d):
    n = F.col("n_nationkey")
    rules = table(spark, d, "nation").select(
        n.alias("rule_order"), F.concat(F.lit("r"), n.cast("string")).alias("rule_name"),
        F.when(n % 3 == 0, F.concat(F.lit("Supplier#0000000"), F.lpad(n.cast("string"), 2, "0"))).when(n % 3 == 1, "SUPPLIER").otherwise(F.concat(F.lit("00000"), n.cast("string"))).alias("alias"),
        F.lit("").alias("source_equals"), F.lit("").alias("url_contains"), (n * 10).cast("bigint").alias("address_id"),
        F.when(n % 2 == 0, "").otherwise("5").alias("street_number"), F.lit("").alias("postal_code"),
    )
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") % 10).cast("string").alias("street_number"))
    return rules_op.alias_match(s, rules, "s_suppkey", ["s_name"]).select("s_suppkey", "address_id", "match_type", "decision")


_PA = """pa AS (SELECT p_partkey, p_name||' '||lower(p_type) AS bn, CAST(p_size AS VARCHAR) AS num, 'Street '||CAST(p_partkey%7 AS VARCHAR) AS st, p_brand AS city, 'V'||CAST(p_partkey%50 AS VARCHAR) AS pc FROM part WHERE p_partkey%2=0),
 pb AS (SELECT p_partkey AS k, p_name||CASE WHEN p_partkey%6=1 THEN '' ELSE ' '||lower(p_type)||CASE WHEN p_partkey%6=3 THEN 's' ELSE '' END END AS bn, CASE WHEN p_partkey%4=1 THEN CAST(p_size AS VARCHAR) ELSE '' END AS num,
  CASE WHEN p_partkey%8=1 THEN 'street '||CAST(p_partkey%7 AS VARCHAR) ELSE '' END AS st, CASE WHEN p_partkey%3=0 THEN p_brand ELSE '' END AS city, CASE WHEN p_partkey%4=1 THEN 'v'||CAST(p_partkey%50 AS VARCHAR) ELSE '' END AS pc FROM part WHERE p_partkey%2=1)"""


def _parts(spark, d):
    k = F.col("p_partkey")
    t = table(spark, d, "part")
    a = t.filter("p_partkey % 2 = 0").select(
        k.alias("address_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("building_name"), F.col("p_size").cast("string").alias("street_number"),
        F.concat(F.lit("Street "), (k % 7).cast("string")).alias("street_name"), F.col("p_brand").alias("city"), F.concat(F.lit("V"), (k % 50).cast("string")).alias("postal_code"),
    )
    short = k % 6 == 1
    name = F.when(short, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"), F.when(k % 6 == 3, "s").otherwise("")))
    b = t.filter("p_partkey % 2 = 1").select(
        k.alias("k"), name.alias("building_name"), F.when(k % 4 == 1, F.col("p_size").cast("string")).otherwise("").alias("street_number"),
        F.when(k % 8 == 1, F.concat(F.lit("street "), (k % 7).cast("string"))).otherwise("").alias("street_name"), F.when(k % 3 == 0, F.col("p_brand")).otherwise("").alias("city"),
        F.when(k % 4 == 1, F.concat(F.lit("v"), (k % 50).cast("string"))).otherwise("").alias("postal_code"),
    )
    return a, b


_SIM = f"""sim AS (SELECT l, r, {_lev('l', 'r')} AS s FROM (SELECT DISTINCT pb.bn AS l FROM pb) x, (SELECT DISTINCT pa.bn AS r FROM pa) y
  WHERE list_has_any(list_filter(string_split(l, ' '), lambda w: length(w)>=3), list_filter(string_split(r, ' '), lambda w: length(w)>=3)))"""
_RES = f"""{_PA}, {_SIM},
 t2 AS (SELECT k, min(p_partkey) AS a, 2 AS t FROM pb JOIN pa ON lower(pb.pc)=lower(pa.pc) AND pb.num=pa.num AND pb.pc<>'' AND pb.num<>'' JOIN sim ON l=pb.bn AND r=pa.bn WHERE s>=85 GROUP BY 1),
 t3 AS (SELECT k, min(p_partkey) AS a, 3 AS t FROM pb JOIN pa ON pb.num=pa.num AND pb.num<>'' AND pb.st<>'' AND lower(pb.st)=lower(pa.st) JOIN sim ON l=pb.bn AND r=pa.bn WHERE s>=75 GROUP BY 1),
 t4 AS (SELECT k, min(p_partkey) AS a, 4 AS t FROM pb JOIN pa ON pb.city<>'' AND lower(pb.city)=lower(pa.city) JOIN sim ON l=pb.bn AND r=pa.bn WHERE s>=90 GROUP BY 1),
 t5 AS (SELECT k, min(p_partkey) AS a, 5 AS t FROM pb JOIN sim ON l=pb.bn JOIN pa ON r=pa.bn WHERE s>=95 GROUP BY 1),
 t6 AS (SELECT k, p_partkey AS a, 6 AS t FROM pb JOIN sim ON l=pb.bn JOIN pa ON r=pa.bn WHERE s>=80 QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, p_partkey)=1),
 al AS (SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4 UNION ALL SELECT * FROM t5 UNION ALL SELECT * FROM t6),
 res AS (SELECT k, arg_min(a, t) AS address_id, min(t) AS tier FROM al GROUP BY 1)"""


@query("resolve_address_native", f"WITH {_RES} SELECT k, address_id, tier FROM res")
def _(spark, d):
    a, b = _parts(spark, d)
    return op.resolve_address(b, a, "k", fz.lev_scores)[0]


@query("address_inserts_native", f"""
WITH {_RES}, f AS (SELECT DISTINCT concat_ws(', ', bn, nullif(trim(concat_ws(' ', nullif(num, ''), nullif(st, ''))), ''), nullif(city, ''), nullif(pc, '')) AS full_address FROM pb WHERE k NOT IN (SELECT k FROM res))
SELECT full_address, (SELECT max(p_partkey) FROM pa)+row_number() OVER (ORDER BY full_address) AS address_id FROM f""")
def _(spark, d):
    a, b = _parts(spark, d)
    return op.resolve_address(b, a, "k", fz.lev_scores)[1].select("full_address", "address_id")


@query("resolve_address")
def _(spark, d):
    a, b = _parts(spark, d)
    return op.resolve_address(b, a, "k")[0]


@query("quick_lookup_native", """
SELECT o_orderkey AS k, o_custkey AS address_id, CASE WHEN o_orderkey%4=0 THEN 1 ELSE 3 END AS step FROM orders WHERE o_orderkey%4<2""")
def _(spark, d):
    def hall(c):
        return F.concat(F.lit("Hall "), F.translate(F.lpad(F.col(c).cast("string"), 9, "0"), "0123456789", "abcdefghij"))

    def line(c):
        return F.concat(hall(c), F.lit(", "), (F.col(c) % 500).cast("string"), F.lit(" Oak St, "), (F.col(c) % 25).cast("string"))

    a = table(spark, d, "customer").select(
        F.col("c_custkey").alias("address_id"), hall("c_custkey").alias("building_name"), line("c_custkey").alias("full_address"),
        (F.col("c_custkey") % 500).cast("string").alias("street_number"), F.lit("oak").alias("street_name"),
    )
    k = F.col("o_orderkey") % 4
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.when(k == 0, F.upper(line("o_custkey")))
        .when(k == 1, F.concat(F.upper(hall("o_custkey")), F.lit(", "), (F.col("o_custkey") % 500).cast("string"), F.lit(" Oak Street")))
        .otherwise(F.concat(F.lit("Nowhere "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "qrstuvwxyz"))).alias("loc"),
    )
    return op.quick_lookup(o, a, "k", "loc", fz.lev_scores, fz.lev_ratio)


@query("location_cache", f"""
WITH {ADDR} SELECT o_orderkey, o_custkey AS address_id FROM orders WHERE o_orderkey%4 IN (0, 1) AND NOT (o_orderkey%4=1 AND o_custkey%2=1)""")
def _(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 4
    a = customer_address(spark, d).select("address_id", "building_name", "street_number", "street_name", F.lit("").alias("direction"), F.lit("full").alias("full_address"))
    text_of = F.concat((c % 500).cast("string"), F.lit(" Street "), (c % 37).cast("string"), F.lit(" key"), c.cast("string"))
    bad = F.concat(F.lit("Lane x key"), (c * 0 - 1).cast("string"), F.lit(" "), c.cast("string"))
    o = table(spark, d, "orders").select("o_orderkey", c, F.when(k == 0, text_of).when((k == 1) & (c % 2 == 1), bad).when(k == 1, text_of).otherwise("unseen").alias("loc"))
    cache = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).select(F.explode(F.array(text_of, bad)).alias("raw_location"), F.col("o_custkey").alias("address_id"))
    return op.cache_lookup(o, cache, a, "o_orderkey", "loc")


@query("location_cache_insert", """
SELECT 'l'||CAST(o_custkey AS VARCHAR) AS raw_location, CASE WHEN o_custkey%2=0 THEN -o_custkey ELSE min(o_orderkey) END AS address_id FROM orders GROUP BY o_custkey
UNION SELECT 'l'||CAST(c_custkey AS VARCHAR), -c_custkey FROM customer WHERE c_custkey%2=0""")
def _(spark, d):
    cache = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("l"), F.col("c_custkey").cast("string")).alias("raw_location"), (-F.col("c_custkey")).alias("address_id"))
    fresh = table(spark, d, "orders").select(F.concat(F.lit("l"), F.col("o_custkey").cast("string")).alias("raw_location"), F.col("o_orderkey").alias("address_id"))
    return op.cache_insert(cache, fresh)


@query("name_in_text", """
WITH v AS (SELECT item_id AS address_id, lower(trim(text)) AS name FROM benchmark), u AS (SELECT name, min(address_id) AS f, max(address_id) AS a FROM v WHERE name<>'' GROUP BY 1)
SELECT doc_id, arg_min(a, f) AS address_id FROM documents JOIN u ON contains(lower(text), name) GROUP BY 1""")
def _(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("address_id"), F.col("text").alias("building_name"))
    docs = wide(spark, d, "documents").select("doc_id", "text")
    names = a.filter(~tx.blank("building_name")).groupBy(F.lower(tx.text("building_name")).alias("name")).agg(F.max("address_id").alias("address_id"), F.min("address_id").alias("first_id"))
    hits = op.contained_in_text(docs, "doc_id", "text", names, "first_id", "name")
    return hits.join(names.select("first_id", "address_id"), "first_id").groupBy("doc_id").agg(F.min_by("address_id", "first_id").alias("address_id"))


@query("name_in_text_fuzzy")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat_ws(" ", F.lit("Live at"), F.lower("c_mktsegment"), F.lit("arena tonight")).alias("body"))
    a = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("address_id")).select(
        "address_id", F.concat(F.replace(F.lower("c_mktsegment"), F.lit("e"), F.lit("a")), F.lit(" arena")).alias("building_name")
    )
    return op.name_in_text(c, a, "k", "body")


@query("postal_lookup", """
WITH cv AS (SELECT c_custkey AS civic_id, 'P'||CAST(c_nationkey AS VARCHAR) AS pc, c_custkey%40 AS no FROM customer), x AS (SELECT o_orderkey, 'P'||CAST(o_custkey%30 AS VARCHAR) AS pc, o_custkey%45 AS num FROM orders)
SELECT o_orderkey, arg_min(civic_id, CASE WHEN no=num THEN 0 ELSE 1000000000 END + civic_id) AS civic_id FROM x JOIN cv USING (pc) GROUP BY 1""")
def _(spark, d):
    k = F.col("c_custkey")
    civic = table(spark, d, "customer").select(k.alias("civic_id"), F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("postal_code"), (k % 40).cast("int").alias("civic_no"), F.col("c_name").alias("formatted"))
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("P"), (F.col("o_custkey") % 30).cast("string")).alias("pc"), F.concat(F.lit("No "), (F.col("o_custkey") % 45).cast("string"), F.lit(" Main 7")).alias("loc"))
    return op.postal_lookup(o, civic, "o_orderkey", "loc", "pc").select("o_orderkey", "civic_id")


_BB = """ad AS (SELECT min(p_partkey) AS a, p_name||' '||lower(p_type) AS bn FROM part WHERE p_partkey%2=0 GROUP BY 2), lc AS (SELECT p_partkey AS k, p_name||' '||lower(p_type)||CASE WHEN p_partkey%3=0 THEN ' x' ELSE 'y' END AS loc FROM part WHERE p_partkey%2=1)"""


@query("best_building_native", f"""
WITH {_BB} SELECT k, a AS address_id FROM lc JOIN ad ON {_lev('loc', 'bn')}>=85 QUALIFY row_number() OVER (PARTITION BY k ORDER BY {_lev('loc', 'bn')} DESC, a)=1""")
def _(spark, d):
    t, k = table(spark, d, "part"), F.col("p_partkey")
    bn = F.concat_ws(" ", "p_name", F.lower("p_type"))
    a = t.filter("p_partkey % 2 = 0").select(k.alias("address_id"), bn.alias("building_name"), F.lit("1 Main, Victoria").alias("full_address"))
    lc = t.filter("p_partkey % 2 = 1").select(k.alias("k"), F.concat(bn, F.when(k % 3 == 0, " x").otherwise("y")).alias("loc"))
    return op.best_building(lc, a, "k", "loc", fz.lev_scores).select("k", "address_id")


@query("best_name_match_native", f"""
WITH x AS (SELECT p_partkey, p_brand, p_name||' '||p_type AS n FROM part), l AS (SELECT p_partkey AS k, p_brand, n||'s' AS n FROM x WHERE p_partkey%2=1), c AS (SELECT p_partkey AS cid, p_brand, n FROM x WHERE p_partkey%2=0)
SELECT k, cid, round({_lev('l.n', 'c.n')}, 4) AS score FROM l JOIN c USING (p_brand) WHERE {_lev('l.n', 'c.n')}>=80 QUALIFY row_number() OVER (PARTITION BY k ORDER BY {_lev('l.n', 'c.n')} DESC, cid)=1""")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("n"))
    l = x.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("k"), "p_brand", F.concat("n", F.lit("s")).alias("n"))
    c = x.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("cid"), "p_brand", "n")
    out = op.best_name_match(l, c, "k", "p_brand", "n", "cid", fz.lev_ratio)
    return out.select("k", "cid", F.round("score", 4).alias("score"))


@query("best_name_match")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("n"))
    l = x.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("k"), "p_brand", F.concat("n", F.lit("s")).alias("n"))
    return op.best_name_match(l, x.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("cid"), "p_brand", "n"), "k", "p_brand", "n", "cid")


@query("venue_token_overlap", """
SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['blue','ring','bolt']) AS overlap FROM part""")
def _(spark, d):
    a, b = tx.venue_tokens(F.concat(F.lit("The "), "p_name")), tx.venue_tokens(F.lit("Blue Ring & Bolt Club, Victoria"))
    return table(spark, d, "part").select("p_partkey", tx.token_overlap(a, b).alias("overlap"))
