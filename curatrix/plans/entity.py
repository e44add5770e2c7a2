"""De-duplication operators over the benchmark data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy as fz
from ..functions import text as tx
from ..operators import entity as op
from ..operators import joins
from ..operators import metrics
from ..operators.graph import connected_components
from ..operators.keyed import spread
from ..session import written
from ..sources.adapters import customer_address, ev, table
from .common import ADDR, EV, label, netloc
from .registry import query


def _docs(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("event_id"), F.concat_ws(" ", "p_name", F.lower("p_type"), F.when(k % 4 == 1, "live")).alias("event_name"), F.col("p_brand").alias("block"),
        (F.col("p_size") % 5).alias("lang"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("https://www."), F.col("p_size").cast("string"), F.lit(".org/"))).alias("url"),
        F.lit("src").alias("source"), F.when(k % 4 != 0, F.col("p_retailprice").cast("string")).alias("location"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("time_stamp"),
    )


_DOC = """doc AS (SELECT p_partkey AS event_id, p_name||' '||lower(p_type)||CASE WHEN p_partkey%4=1 THEN ' live' ELSE '' END AS event_name, p_brand AS block, p_size%5 AS lang,
 CASE WHEN p_partkey%3=0 THEN '' ELSE 'u' END AS url, CASE WHEN p_partkey%4<>0 THEN CAST(p_retailprice AS VARCHAR) END AS location FROM part)"""
_LEV = "(1-levenshtein({a}, {b})/greatest(length({a}), length({b})))*100"
def _recursive(edges_cte: str, edges: str) -> str:
    return f"""WITH RECURSIVE {edges_cte}, reach(id, r) AS (SELECT x, x FROM {edges} UNION SELECT reach.id, e2.y FROM reach JOIN {edges} e2 ON e2.x=reach.r),
 comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""


_FZE = f"""{_DOC}, pr AS (SELECT a.event_id AS x, b.event_id AS y FROM doc a JOIN doc b ON a.block=b.block AND a.lang=b.lang AND a.event_id<b.event_id AND {_LEV.format(a='a.event_name', b='b.event_name')}>80
   AND least(length(a.event_name), length(b.event_name))*200.0 > 80*(length(a.event_name)+length(b.event_name))),
 e AS (SELECT x, y FROM pr UNION SELECT y, x FROM pr)"""


@query("fuzzy_duplicates_native", _recursive(_FZE, "e") + """,
 s AS (SELECT d.*, component, row_number() OVER (PARTITION BY component ORDER BY (url=''), -(CASE WHEN location IS NULL THEN 0 ELSE 1 END), event_id) AS rn FROM doc d JOIN comp ON id=event_id)
SELECT event_id, component, rn=1 AS is_canonical FROM s""")
def _(spark, d):
    return op.fuzzy_dedup(_docs(spark, d), ["block", "lang"], threshold=80, score=fz.lev_ratio)[1]


@query("fuzzy_duplicate_survivors", _recursive(_FZE, "e") + """,
 s AS (SELECT d.*, component, row_number() OVER (PARTITION BY component ORDER BY (url=''), -(CASE WHEN location IS NULL THEN 0 ELSE 1 END), event_id) AS rn FROM doc d JOIN comp ON id=event_id)
SELECT component, max(event_id) FILTER (WHERE rn=1) AS event_id, arg_min(location, rn) FILTER (WHERE location IS NOT NULL) AS location FROM s GROUP BY 1""")
def _(spark, d):
    return op.fuzzy_dedup(_docs(spark, d), ["block", "lang"], threshold=80, score=fz.lev_ratio)[0].select("component", "event_id", "location")


@query("fuzzy_duplicates")
def _(spark, d):
    return op.fuzzy_dedup(_docs(spark, d), ["block", "lang"], threshold=80)[1]


@query("preferred_row", f"""
WITH x AS (SELECT page_id, {netloc('url')} AS dom, CASE WHEN page_id%2=0 THEN {label('url')} ELSE 'Other' END AS src, CASE WHEN page_id%5=0 THEN '' ELSE url END AS u, CASE WHEN page_id%3=0 THEN NULL ELSE 'p' END AS price FROM pages)
SELECT dom, page_id FROM x QUALIFY row_number() OVER (PARTITION BY dom ORDER BY CASE WHEN u<>'' AND src<>'Other' THEN 0 ELSE 1 END, (u=''), CASE WHEN price IS NULL THEN 1 ELSE 0 END, page_id)=1""")
def _(spark, d):
    from ..functions.urls import netloc as net
    from ..functions.urls import source_from_url

    k = F.col("page_id")
    p = table(spark, d, "pages").select(
        k.alias("event_id"), net("url").alias("dom"), F.when(k % 2 == 0, source_from_url("url")).otherwise("Other").alias("source"),
        F.when(k % 5 == 0, "").otherwise(F.col("url")).alias("url"), F.when(k % 3 != 0, "p").alias("price"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("time_stamp"),
    )
    ranked = p.withColumn("_rank", op.survivor_rank(p, ["source", "url", "price"]))
    return ranked.groupBy("dom").agg(F.min("_rank").alias("b")).select("dom", F.col("b.e").alias("page_id"))


@query("fill_from_group", """
WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus='P' THEN '' ELSE o_orderpriority END AS p, CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_orderstatus END AS s FROM orders)
SELECT o_custkey, arg_min(p, o_orderkey) FILTER (WHERE p<>'') AS p, arg_min(s, o_orderkey) FILTER (WHERE s IS NOT NULL) AS s FROM x GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("p"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("s"),
    )
    return op.coalesce_group(o, "o_custkey", "o_orderkey", ["p", "s"])


@query("longest_wins", """
WITH p AS (SELECT doc_id, text, CASE WHEN doc_id%4=0 THEN NULL ELSE lang END AS lang, lead(text) OVER (ORDER BY doc_id) AS t2, 'xyz' AS l2 FROM documents)
SELECT doc_id, length(CASE WHEN text='' THEN t2 WHEN length(t2)>length(text) THEN t2 ELSE text END) AS n, CASE WHEN lang IS NULL THEN l2 WHEN length(l2)>length(lang) THEN l2 ELSE lang END AS lang
FROM p WHERE t2 IS NOT NULL AND doc_id%2=0""")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", "lang")
    a = t.filter("doc_id % 2 = 0").select("doc_id", F.col("text").alias("text_1"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang_1"))
    b = t.filter("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_2"), F.lit("xyz").alias("lang_2"))
    m = op.merge_longest(a.join(b, "doc_id"), ["text", "lang"])
    return m.select("doc_id", F.length("text").alias("n"), "lang")


_CS = """c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus='P' THEN '' ELSE 'Hall '||o_orderpriority END AS loc, o_orderpriority AS src, o_custkey%2=0 AS post, length(o_orderpriority) AS n FROM orders),
 sc AS (SELECT *, CASE WHEN loc='' THEN -1e9 ELSE 1 + CASE WHEN post THEN 1 ELSE 0 END + 0.5*4 - 0 + 0.01*n*(1+o_orderkey%9) - CASE WHEN src='1-URGENT' THEN 3 ELSE 0 END - CASE WHEN contains(lower(src), 'low') THEN 0.25 ELSE 0 END END AS score FROM c)"""


@query("canonical_score", f"""
WITH {_CS} SELECT o_orderkey, round(score, 4) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey)=1 AS is_canonical FROM sc""")
def _(spark, d):
    k = F.col("o_orderkey")
    e = table(spark, d, "orders").select(
        k.alias("event_id"), F.col("o_custkey").alias("address_id"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("Hall "), "o_orderpriority")).alias("location"),
        F.repeat(F.col("o_orderpriority"), (1 + k % 9).cast("int")).alias("description"), F.lit("n").alias("event_name"), F.col("o_orderpriority").alias("source"),
        F.lit("s").alias("dance_style"), F.lit("t").alias("event_type"), F.lit(5).alias("start_sec"), F.lit("").alias("url"),
    )
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("address_id"), F.when(F.col("c_custkey") % 2 == 0, "V8N 1S3").alias("postal_code"))
    pen = table(spark, d, "region").filter("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, "1-Urgent").alias("source_equals"), F.when(F.col("r_regionkey") == 1, "LOW").alias("source_contains"),
        F.when(F.col("r_regionkey") == 0, 3.0).otherwise(0.25).alias("penalty"),
    )
    s = op.mark_canonical(op.canonical_score(e, a, pen), "address_id")
    score = F.when(F.col("score") < -1e6, -1e9).otherwise(F.round("score", 4))
    return s.select(F.col("event_id").alias("o_orderkey"), score.alias("score"), "is_canonical")


_VP = """vp AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id<b.vec_id
 AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))>=0.3), ve AS (SELECT id_a AS x, id_b AS y FROM vp UNION SELECT id_b, id_a FROM vp)"""


@query("similar_vectors", f"WITH {_VP} SELECT id_a, id_b FROM vp")
def _(spark, d):
    return op.similar_vectors(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.3).select("id_a", "id_b")


@query("density_clusters", _recursive(_VP, "ve") + " SELECT id, component FROM comp")
def _(spark, d):
    pairs = op.similar_vectors(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.3)
    return op.density_clusters(pairs)


def _vector_events(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(
        F.col("vec_id").alias("event_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("label")).alias("start_date"), ((F.col("vec_id") * 37) % 3600).cast("int").alias("start_sec"),
        F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 2).alias("address_id"), F.lit("Hall A").alias("location"), F.lit("d").alias("description"), F.lit("n").alias("event_name"),
        F.lit("s").alias("source"), F.lit("").alias("dance_style"), F.lit("").alias("event_type"), F.lit("").alias("url"), F.col("embedding").alias("vec"),
    )


_EC = """w AS (SELECT vec_id AS i, label AS l, (vec_id*37)%3600 AS s, CASE WHEN vec_id%3<>0 THEN vec_id%2 END AS ad, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 wp AS (SELECT a.i AS id_a, b.i AS id_b FROM w a JOIN w b ON a.l=b.l AND a.i<b.i AND abs(a.s-b.s)<=1800 AND (a.ad IS NULL OR b.ad IS NULL OR a.ad=b.ad) AND list_cosine_similarity(a.v, b.v)>=0.3),
 we AS (SELECT id_a AS x, id_b AS y FROM wp UNION SELECT id_b, id_a FROM wp)"""


def _clusters(spark, d):
    addr = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("address_id"), F.lit(None).cast("string").alias("postal_code"))
    pen = table(spark, d, "region").select(F.col("r_name").alias("source_equals"), F.lit("").alias("source_contains"), F.lit(1.0).alias("penalty"))
    return op.embedding_clusters(_vector_events(spark, d), addr, pen, "vec", eps=0.7)


@query("embedding_clusters", _recursive(_EC, "we") + """
SELECT id AS event_id, component, row_number() OVER (PARTITION BY component ORDER BY CASE WHEN id%3<>0 THEN 1 ELSE 0 END DESC, id)=1 AS is_canonical FROM comp""")
def _(spark, d):
    return _clusters(spark, d).select("event_id", "component", "is_canonical")


@query("dedup_stats", _recursive(_EC, "we") + """
SELECT count(*) AS rows, count(DISTINCT component) AS clusters, count(DISTINCT component) AS canonical_rows, count(*)-count(DISTINCT component) AS duplicate_rows FROM comp""")
def _(spark, d):
    return metrics.dedup_stats(_clusters(spark, d))


def _named_addresses(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return v.join(p, v["vec_id"] == p["p_partkey"]).select(
        F.col("vec_id").alias("address_id"), F.col("p_name").alias("building_name"), "embedding", "label", (F.col("vec_id") % 3).cast("string").alias("street_number"),
        F.lit("Main").alias("street_name"), F.lit("Victoria").alias("city"), F.lit("").alias("postal_code"),
    )


@query("address_clusters")
def _(spark, d):
    a = _named_addresses(spark, d)
    comp = op.density_clusters(op.similar_vectors(a, ["label"], "address_id", "embedding", 0.3))
    members = a.join(comp, a["address_id"] == comp["id"]).drop("id", "embedding")
    sub = op.name_subclusters(members, "component", "building_name", "address_id")
    return op.address_cluster_rules(members.join(sub, "address_id"))


@query("connected_components", _recursive(f"""{ADDR}, pr AS (SELECT a.address_id AS x, b.address_id AS y FROM addr a JOIN addr b ON a.address_id<b.address_id AND (a.street_number=b.street_number AND a.street_name=b.street_name
 OR a.city=b.city AND a.address_id//40=b.address_id//40)), e AS (SELECT x, y FROM pr UNION SELECT y, x FROM pr)""", "e") + " SELECT id, component FROM comp")
def _(spark, d):
    a = customer_address(spark, d).withColumn("near", F.floor(F.col("address_id") / 40))
    stars = None
    for keys in (["street_number", "street_name"], ["city", "near"]):
        first = a.groupBy(*keys).agg(F.min("address_id").alias("root"))
        part = a.join(first, keys).filter("address_id <> root").select(F.col("root").alias("x"), F.col("address_id").alias("y"))
        stars = part if stars is None else stars.unionByName(part)
    return connected_components(stars, "x", "y")


@query("apply_merge", """
SELECT 'fact' AS side, o_orderkey AS row_id, CASE WHEN o_custkey%10=3 THEN o_custkey-3 ELSE o_custkey END AS address_id FROM orders
UNION ALL SELECT 'dim', c_custkey, c_custkey FROM customer WHERE c_custkey%10<>3""")
def _(spark, d):
    k = F.col("c_custkey")
    dim = table(spark, d, "customer").select(k.alias("address_id"))
    m = table(spark, d, "customer").filter("c_custkey % 10 = 3").select(k.alias("duplicate_id"), (k - 3).alias("canonical_id"))
    kept, moved = op.apply_merge(dim, table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("address_id")), m, "address_id")
    return moved.select(F.lit("fact").alias("side"), "row_id", "address_id").unionByName(
        kept.select(F.lit("dim").alias("side"), F.col("address_id").alias("row_id"), "address_id"))


_CP = """p AS (SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.start_date=b.start_date AND a.place=b.place AND a.start_sec//3600=b.start_sec//3600 AND a.event_id<b.event_id AND a.event_type<>b.event_type),
 dd AS (SELECT a, b, CASE WHEN a%4 IN (0,3) THEN a WHEN a%4=1 THEN NULL ELSE 0 END AS c, CASE WHEN a%4=1 THEN a WHEN a%4=3 THEN a END AS i FROM p)"""


@query("conflict_decisions", f"""
WITH {EV}, {_CP}, n AS (SELECT a, b, coalesce(c, CASE WHEN i=a THEN b WHEN i=b THEN a END) AS r, coalesce(i, CASE WHEN c=a THEN b WHEN c=b THEN a END) AS w FROM dd)
SELECT a AS event_id_1, b AS event_id_2, CASE WHEN r IS NULL OR w IS NULL OR r NOT IN (a,b) OR w NOT IN (a,b) THEN 'ids_outside_pair' WHEN r=w THEN 'same_id' ELSE 'valid' END AS verdict FROM n""")
def _(spark, d):
    e = ev(spark, d).withColumn("slot", F.floor(F.col("start_sec") / 3600))
    pairs = joins.venue_conflict_pairs(e, ["start_date", "place", "slot"], "event_type").select("event_id_1", "event_id_2")
    k = F.col("event_id_1") % 4
    decisions = pairs.select(
        "event_id_1", "event_id_2", F.when(k.isin(0, 3), F.col("event_id_1")).when(k == 2, F.lit(0)).alias("correct_event_id"),
        F.when(k.isin(1, 3), F.col("event_id_1")).alias("incorrect_event_id"),
    )
    return op.conflict_decisions(pairs, decisions).select("event_id_1", "event_id_2", "verdict")


@query("repeat_signature", r"""
SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))""")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha1(tx.squeeze("text")).alias("signature"))
    return op.first_per_signature(t, "signature", "doc_id").select("doc_id")


def _indel(a, b):
    """100 * 2 lcs / total length in SQL: one bit per sign of ``a`` in a 128-bit number, one step per sign of ``b``."""
    full = f"((1::HUGEINT << length({a}))-1)"
    masks = f"list_transform(string_split({b}, ''), lambda ch: list_sum(list_transform(range(1, length({a})+1), lambda i: CASE WHEN substr({a}, i, 1)=ch THEN 1::HUGEINT << CAST(i-1 AS INTEGER) ELSE 0::HUGEINT END))::HUGEINT)"
    state = f"list_reduce(list_prepend({full}, {masks}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})"
    return f"(200.0*(length({a})-bit_count({state}))/(length({a})+length({b})))"


@query("indel_scores", f"""
WITH x AS (SELECT c_custkey, lower(c_mktsegment)||' '||p_name AS a, p_name||' hall '||lower(p_type) AS b, c_name AS n FROM customer JOIN part ON c_custkey=p_partkey),
y AS (SELECT *, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM x)
SELECT c_custkey, round({_indel('a', 'b')}, 6) AS ratio, round({_indel('sa', 'sb')}, 6) AS token_sort, round({_indel('n', 'b')}, 6) AS other FROM y""")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.lower("c_mktsegment").alias("segment"))
    j = c.join(table(spark, d, "part").select("p_partkey", "p_name", F.lower("p_type").alias("kind")), F.col("c_custkey") == F.col("p_partkey"))
    a, b = F.concat_ws(" ", "segment", "p_name"), F.concat_ws(" ", "p_name", F.lit("hall"), "kind")
    return j.select(
        "c_custkey", F.round(fz.indel_ratio(a, b), 6).alias("ratio"), F.round(fz.token_sort_ratio(a, b), 6).alias("token_sort"),
        F.round(fz.indel_ratio(F.col("c_name"), b), 6).alias("other"),
    )


@query("fuzzy_scores")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    j = c.join(p, c["c_custkey"] == p["p_partkey"])
    a, b = F.concat_ws(" ", F.lower("c_mktsegment"), "p_name"), F.concat_ws(" ", "p_name", F.lit("hall"))
    rows = j.select("c_custkey", a.alias("a"), b.alias("b"))
    # equal pairs of texts are scored once
    x, y = F.col("x"), F.col("y")
    scored = spread(rows.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct(), "x", "y").select(
        "x", "y", fz.indel_ratio(x, y).alias("ratio"), fz.partial_ratio(x, y).alias("partial"), fz.token_sort_ratio(x, y).alias("token_sort"),
        fz.token_set_ratio(x, y).alias("token_set"), fz.sequence_ratio(x, y).alias("sequence"),
    )
    return rows.join(written(scored), (F.col("a") == x) & (F.col("b") == y)).drop("a", "b", "x", "y")
