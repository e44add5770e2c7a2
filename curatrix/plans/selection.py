"""Top-k, sampling and set operators over the benchmark data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import netloc as part_netloc
from ..operators import metrics
from ..operators import normalize
from ..operators import selection as op
from ..sources.adapters import table, wide
from .common import ORD, compare_key, host, netloc
from .registry import query


def _day(t):
    return F.lit(t).cast("date")


@query("top_sources", """
SELECT p_brand, count(*) AS counted, round(100.0*count(*)/(SELECT count(*) FROM part), 2) AS share_pct FROM part GROUP BY 1 ORDER BY counted DESC, p_brand LIMIT 10""")
def _(spark, d):
    return metrics.top_k(table(spark, d, "part"), "p_brand", 10)


_LINKS = r"""h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS hs FROM pages),
 x AS (SELECT page_id, base, unnest(hs) AS href, generate_subscripts(hs, 1) AS i FROM h),
 a AS (SELECT page_id, CASE WHEN href LIKE '/%' THEN base||href ELSE href END AS link, min(i) AS i FROM x GROUP BY 1, 2),
 links AS (SELECT page_id, link, i FROM a WHERE link LIKE 'http://%' OR link LIKE 'https://%')"""
_SCORE = ("(CASE WHEN contains(lower(link),'calendar') OR contains(lower(link),'event') OR contains(lower(link),'schedule') OR contains(lower(link),'social') "
          "OR contains(lower(link),'month') OR contains(lower(link),'list') THEN 5 ELSE 0 END + CASE WHEN contains(lower(link),'/events/') THEN 4 ELSE 0 END)")


@query("link_priority", f"""
WITH {_LINKS} SELECT page_id, link, {_SCORE} AS score FROM links QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {_SCORE} DESC, i)<=3""")
def _(spark, d):
    links = normalize.page_links(wide(spark, d, "pages").select("page_id", "url", "html"), "page_id")
    return op.link_priority(links, "page_id", 3).select("page_id", "link", "score")


@query("near_future_sample", f"""
WITH {ORD} SELECT o_orderkey FROM o WHERE d BETWEEN DATE '1999-03-01'+7 AND DATE '1999-03-01'+21 ORDER BY md5(CAST(o_orderkey AS VARCHAR)||'s1') LIMIT 20""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return op.near_future_sample(o, "d", _day("1999-03-01"), 20, "s1", "o_orderkey").select("o_orderkey")


@query("recent_messages", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)<=3")
def _(spark, d):
    return op.recent_messages(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query("distinct_domain_sample", f"""
SELECT {host('url')} AS domain, min(page_id) AS page_id FROM pages WHERE NOT contains({host('url')}, 'shop.') GROUP BY 1 ORDER BY 1 LIMIT 30""")
def _(spark, d):
    return op.one_per_domain(wide(spark, d, "pages"), "url", "page_id", 30, ("shop.",)).select("domain", "page_id")


@query("balanced_pick", """
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rn FROM labels)
SELECT doc_id, quality FROM r WHERE rn<=least(25, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)))""")
def _(spark, d):
    return op.balanced_pick(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 40, 25)


@query("capped_promotion", f"""
WITH q AS (SELECT page_id, {netloc('url')} AS dom, substr(url, length(url), 1) AS arch, page_id%9<>0 AS elig, page_id%5=0 AS known, page_id%7=3 AS held FROM pages),
st AS (SELECT dom, arch, count(*) AS n FROM q WHERE known GROUP BY 1, 2),
e AS (SELECT q.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY dom, arch ORDER BY page_id) AS rn FROM q LEFT JOIN st USING (dom, arch) WHERE NOT held AND NOT known AND elig),
w AS (SELECT *, row_number() OVER (ORDER BY page_id) AS g FROM e WHERE rn+n<=2)
SELECT q.page_id, CASE WHEN q.held THEN 'evaluation_url_excluded' WHEN q.known THEN 'duplicate_url' WHEN NOT q.elig THEN 'not_training_eligible'
 WHEN g<=60 THEN 'promoted' WHEN g IS NOT NULL THEN 'promotion_limit_reached' ELSE 'domain_archetype_cap_reached' END AS outcome FROM q LEFT JOIN w USING (page_id)""")
def _(spark, d):
    own = F.concat(F.lit("https://"), part_netloc("url"), F.lit("/p"), F.col("page_id").cast("string"))
    p = wide(spark, d, "pages").select(
        "page_id", own.alias("url"), F.right("url", F.lit(1)).alias("archetype"), (F.col("page_id") % 9 != 0).alias("training_eligible")
    )
    stored = p.filter("page_id % 5 = 0").select("url", "archetype")
    held = p.filter("page_id % 7 = 3").select("url")
    return op.capped_promotion(p, stored, held, [F.asc("page_id")], 60, 2).select("page_id", "outcome")


@query("rank_images", """
WITH s AS (SELECT p_brand, p_partkey, p_size*40 AS w, CAST(p_retailprice AS BIGINT) AS h FROM part),
x AS (SELECT *, CASE WHEN p_partkey%3=0 THEN 120 WHEN p_partkey%3=1 THEN 90 ELSE 0 END + CASE WHEN p_partkey%5=0 THEN 35 ELSE 0 END + least(40, w*h//50000)
 + CASE WHEN h>=w*1.1 AND h<=w*2.3 THEN 25 WHEN w>=h*0.85 AND w<=h*1.2 THEN 12 WHEN w>=h*2.0 OR h>=w*3.0 THEN -30 ELSE 0 END AS score FROM s)
SELECT p_brand, p_partkey, CAST(score AS BIGINT) AS score FROM x QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey)<=4""")
def _(spark, d):
    k = F.col("p_partkey")
    host = F.when(k % 3 == 0, "scontent.fbcdn.net").when(k % 3 == 1, "scontent.cdninstagram.com").otherwise("a.org")
    p = table(spark, d, "part").select(
        "p_brand", "p_partkey", F.concat(F.lit("https://"), host, F.when(k % 5 == 0, "/v/t51/x.jpg").otherwise("/x.jpg")).alias("img"),
        (F.col("p_size") * 40).alias("w"), F.rint("p_retailprice").cast("bigint").alias("h"),  # SQL rounds
    )
    return op.rank_images(p, "p_brand", "img", "w", "h", "p_partkey", 4).select("p_brand", "p_partkey", "score")


@query("merge_seeds", f"""
WITH s AS (SELECT 0 AS l, 'a' AS src, url AS link FROM pages WHERE page_id%3=0 UNION ALL SELECT 1, 'b', regexp_replace(url, '#.*$', '')||'#x' FROM pages WHERE page_id%2=0)
SELECT src AS source, link FROM (SELECT *, {compare_key('link')} AS k FROM s) QUALIFY row_number() OVER (PARTITION BY k ORDER BY l, link)=1""")
def _(spark, d):
    p = wide(spark, d, "pages")
    a = p.filter("page_id % 3 = 0").select(F.lit("a").alias("source"), F.col("url").alias("link"))
    b = p.filter("page_id % 2 = 0").select(F.lit("b").alias("source"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#x")).alias("link"))
    return op.merge_seeds(a, b)


@query("stale_in_all_runs", """
WITH e AS (SELECT DISTINCT date_trunc('week', ts) AS w, user_id FROM events WHERE event_type='error'), r AS (SELECT DISTINCT w FROM e ORDER BY w DESC LIMIT 3)
SELECT user_id FROM e WHERE w=(SELECT max(w) FROM r) INTERSECT SELECT user_id FROM e WHERE w=(SELECT w FROM r ORDER BY w DESC LIMIT 1 OFFSET 1) INTERSECT SELECT user_id FROM e WHERE w=(SELECT min(w) FROM r)""")
def _(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.date_trunc("week", "ts").alias("w"), "user_id")
    return op.in_all_latest_runs(e, "w", "user_id", 3)


@query("new_domains", f"""
SELECT {host('url')} AS domain FROM pages EXCEPT SELECT {host('url')} FROM pages WHERE page_id%4=0""")
def _(spark, d):
    p = wide(spark, d, "pages")
    return op.new_domains(p, "url", p.filter("page_id % 4 = 0"), "url")


@query("eval_split", """
WITH b AS (SELECT item_id, 'src'||CAST(item_id AS VARCHAR) AS k FROM benchmark)
SELECT doc_id, CASE WHEN source IN (SELECT k FROM b WHERE item_id%2=0 AND item_id%10<>0) THEN 'holdout' WHEN source IN (SELECT k FROM b WHERE item_id%5=1) THEN 'dev' ELSE 'train' END AS split FROM documents""")
def _(spark, d):
    b = table(spark, d, "benchmark").select(
        "item_id", F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("k"), F.when(F.col("item_id") % 10 == 0, "No").otherwise("").alias("active")
    )
    docs = wide(spark, d, "documents").select("doc_id", "source")
    return op.eval_split(docs, "source", b.filter("item_id % 5 = 1"), b.filter("item_id % 2 = 0"), "k").select("doc_id", "split")


@query("passage_holdout", """
SELECT DISTINCT doc_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)""")
def _(spark, d):
    from ..operators.rules import contained_in_text

    docs = wide(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return contained_in_text(docs, "doc_id", "text", items, "item_id", "passage", lower=False).select("doc_id").distinct()
