"""Page classification over the benchmark data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as op
from ..operators.rules import contained_in_text
from ..operators.normalize import visible_text_native
from ..session import written
from ..sources.adapters import table, wide
from .common import netloc, path, qry
from .normalize import _VT
from .registry import query

_M = r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)\b"


def _n(pattern):
    return f"len(regexp_extract_all(t, '{pattern}'))"


@query("html_text_features", rf"""
WITH x AS (SELECT page_id, lower({_VT}) AS t, lower(html) AS h FROM pages)
SELECT page_id, {_n(_M)} AS months, {_n(op.WEEKDAY_WORDS)} + {_n(_M)} AS date_count, {_n(op.TIME_WORDS)} AS time_count,
 len(list_filter(regexp_extract_all(h, '<a\s[^>]*href="([^"]*)"', 1), lambda v: contains(v, 'ticket') OR contains(v, 'regist') OR contains(v, 'buy') OR contains(v, 'admission') OR contains(v, 'eventbrite')))
 + len(list_filter(regexp_extract_all(h, '(?s)<a\s[^>]*href[^>]*>(.*?)</a>', 1), lambda v: contains(v, 'ticket') OR contains(v, 'regist') OR contains(v, 'buy') OR contains(v, 'admission') OR contains(v, 'eventbrite'))) AS ticket_link_count FROM x""")
def _(spark, d):
    f = op.html_features(wide(spark, d, "pages"))
    months = F.regexp_count(F.lower(visible_text_native("html")), F.lit(op.MONTH_WORDS))
    return f.select("page_id", months.alias("months"), "date_count", "time_count", "ticket_link_count")


@query("html_features")
def _(spark, d):
    return op.html_features(wide(spark, d, "pages")).drop("html")


_RULES = f"""r AS (SELECT page_id, url, lower({_VT}) AS t, len(regexp_extract_all(html, '<li>'))%9 AS n, {path('url')} AS p FROM pages),
 c AS (SELECT *, CASE WHEN contains(url, '/en/') THEN 'event_detail' WHEN contains(p, '/fr') OR n>=3 OR (contains(t, 'zqx') AND n>=6) THEN 'incomplete_event' WHEN contains(t, 'ander') THEN 'simple_page' ELSE 'other' END AS subtype FROM r)"""


def _classified(spark, d):
    p = wide(spark, d, "pages").withColumns({"body": visible_text_native("html"), "n": F.regexp_count("html", F.lit("<li>")) % 9})
    return p.withColumn("rule", op.classify_rules("url", F.col("body"), F.col("n"), None, ("/en/",), ("/fr",), ("ander",), ("zqx",)))


@query("classify_rules", f"WITH {_RULES} SELECT page_id, CASE subtype WHEN 'event_detail' THEN 'simple_page' ELSE subtype END AS archetype, subtype, 'scraper.py' AS owner_step FROM c")
def _(spark, d):
    return _classified(spark, d).select("page_id", "rule.archetype", "rule.subtype", "rule.owner_step")


@query("classify_platforms", """
SELECT page_id, CASE page_id%8 WHEN 0 THEN 'email_input' WHEN 1 THEN 'google_calendar' WHEN 2 THEN 'facebook_event_detail' WHEN 3 THEN 'instagram_post_detail' WHEN 4 THEN 'social_listing_or_profile'
 WHEN 5 THEN 'eventbrite_event_detail' WHEN 6 THEN 'eventbrite_organizer' ELSE 'event_detail' END AS subtype,
 CASE WHEN page_id%8=0 THEN 'emails.py' WHEN page_id%8 IN (2,3,4) THEN 'fb.py' WHEN page_id%8 IN (5,6) THEN 'ebs.py' ELSE 'scraper.py' END AS owner_step FROM pages""")
def _(spark, d):
    k, i = F.col("page_id") % 8, F.col("page_id").cast("string")
    url = (
        F.when(k == 0, F.concat(F.lit("box"), i, F.lit("@mail.org"))).when(k == 1, F.concat(F.lit("https://calendar.google.com/calendar/embed?src="), i))
        .when(k == 2, F.concat(F.lit("https://www.facebook.com/events/"), i)).when(k == 3, F.concat(F.lit("https://instagram.com/reel/"), i))
        .when(k == 4, F.concat(F.lit("https://m.facebook.com/club"), i)).when(k == 5, F.concat(F.lit("https://www.eventbrite.ca/e/ball-tickets-"), i))
        .when(k == 6, F.concat(F.lit("https://www.eventbrite.com/o/club-"), i)).otherwise(F.concat(F.lit("https://hall.org/event/"), i))
    )
    p = wide(spark, d, "pages").select("page_id", url.alias("url"))
    return p.select("page_id", op.classify_rules("url", F.lit(""), F.lit(0)).alias("r")).select("page_id", "r.subtype", "r.owner_step")


_MON = "+".join(f"len(regexp_extract_all(t, '{m}'))" for m in "jan feb mar apr may jun jul aug sep oct nov dec".split())
_SCO = f"""{_RULES}, s AS (SELECT *, CASE WHEN contains(p, '/fr') THEN 3 ELSE 0 END + CASE WHEN n>=3 THEN 2 ELSE 0 END + CASE WHEN contains(t, 'zqx') THEN 1 ELSE 0 END + CASE WHEN {_MON}>=4 THEN 1 ELSE 0 END AS sc, contains(t, 'ander') AS sig FROM c)"""


@query("classify_scored", f"""
WITH {_SCO} SELECT page_id, sc AS listing_score, CASE WHEN subtype='event_detail' THEN 'simple_page' WHEN sc<3 AND sig THEN subtype ELSE 'incomplete_event' END AS archetype,
 CASE WHEN subtype='event_detail' THEN 'rule' ELSE 'structural' END AS stage,
 round(CASE WHEN subtype='event_detail' THEN 0.99 WHEN sc>=3 THEN least(0.70+0.05*least(sc, 4), 0.90) WHEN sig THEN CASE WHEN n<=2 THEN 0.68 ELSE 0.60 END ELSE 0.52 END::DOUBLE, 4) AS confidence FROM s""")
def _(spark, d):
    c = op.classify_scored(_classified(spark, d), "body", "n", None, ("/fr",), ("ander",), ("zqx",))
    return c.select("page_id", "listing_score", "archetype", "stage", F.round("confidence", 4).alias("confidence"))


@query("routing_override", f"""
WITH {_SCO}, b AS (SELECT page_id, subtype='event_detail' AS rule, CASE WHEN subtype='event_detail' THEN 'simple_page' WHEN sc<3 AND sig THEN subtype ELSE 'incomplete_event' END AS a FROM s)
SELECT page_id, CASE WHEN page_id%3=0 AND NOT rule THEN 'google_calendar' ELSE a END AS archetype, CASE WHEN rule THEN 'rule' WHEN page_id%3=0 THEN 'memory' ELSE 'structural' END AS stage FROM b""")
def _(spark, d):
    c = op.classify_scored(_classified(spark, d), "body", "n", None, ("/fr",), ("ander",), ("zqx",)).withColumn("own", F.concat(F.lit("p"), F.col("page_id").cast("string")))
    memory = wide(spark, d, "pages").filter("page_id % 3 = 0").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("link"), F.lit("google_calendar").alias("archetype"), F.lit(0.9).alias("avg_confidence"))
    return op.apply_routing_memory(c, memory, "own").select("page_id", "archetype", "stage")


@query("model_features", f"""
SELECT page_id, len(list_filter(string_split({path('url')}, '/'), lambda x: x<>'')) AS path_depth, {qry('url')}<>'' AS has_query,
 contains({path('url')}, 'html') AS html FROM pages""")
def _(spark, d):
    f = op.model_features(wide(spark, d, "pages").select("page_id", "url"), families=())
    return f.select("page_id", "path_depth", F.array_contains("tokens", "has_query").alias("has_query"), F.lower("url").rlike("^[^?#]*html").alias("html"))


def _training(spark, d):
    docs = wide(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    held = contained_in_text(docs, "doc_id", "text", items, "item_id", "passage", lower=False).select("doc_id").distinct()
    docs = docs.join(held, "doc_id", "left_anti")
    lab = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return docs.select("doc_id", words.alias("tokens")).join(lab, "doc_id")


@query("classifier_training_set", """
SELECT doc_id, round(n/(2.0*sum(1) OVER (PARTITION BY quality)), 6) AS weight FROM (SELECT doc_id, quality, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id)
 WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(documents.text, b.text)))""")
def _(spark, d):
    return op.balanced_weights(_training(spark, d), "label").select("doc_id", F.round("weight", 6).alias("weight"))


@query("classifier_predictions")
def _(spark, d):
    rows = written(_training(spark, d))  # read by each step of the training
    model, indexer = op.train_classifier(rows, "label", max_iter=5)
    return op.predict_classifier(model, indexer, rows).select("doc_id", "label", "predicted", "confidence")


@query("step_ownership", f"""
WITH {_RULES}, st AS (SELECT page_id, s FROM c, (VALUES ('scraper.py'), ('fb.py'), ('rd_ext.py')) v(s))
SELECT page_id, s AS step, s='scraper.py' OR (s='rd_ext.py' AND page_id%2=0) AS allow,
 CASE WHEN s='scraper.py' THEN 'owner_match' WHEN s='rd_ext.py' AND page_id%2=0 THEN 'edge_case_delegate_allowed' ELSE 'owned_by_scraper.py' END AS reason FROM st""")
def _(spark, d):
    c = _classified(spark, d).withColumn("step", F.explode(F.array(*[F.lit(s) for s in ("scraper.py", "fb.py", "rd_ext.py")])))
    o = op.step_ownership(F.col("rule.owner_step"), F.col("step"), F.col("page_id") % 2 == 0)
    return c.select("page_id", "step", o.alias("o")).select("page_id", "step", "o.allow", "o.reason")


@query("text_vectors")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    v = op.text_vectors(wide(spark, d, "documents").select("doc_id", "text", "lang"), ["text", "lang"], buckets=1 << 10)
    norm = F.aggregate(vector_to_array("vec"), F.lit(0.0), lambda a, x: a + x * x)
    return v.select("doc_id", F.round(norm, 6).alias("squared_norm"))


_FR = r"""h AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS hs FROM pages),
 x AS (SELECT page_id, url, base, unnest(hs) AS href, generate_subscripts(hs, 1) AS i FROM h), a AS (SELECT page_id, url, CASE WHEN href LIKE '/%' THEN base||href ELSE href END AS link, min(i) AS i FROM x GROUP BY 1, 2, 3),
 l AS (SELECT * FROM a WHERE link LIKE 'http://%' OR link LIKE 'https://%')"""


@query("link_frontier", f"""
WITH {_FR}, f AS (SELECT page_id, link, i, page_id%5=0 AND {netloc('link')}={netloc('url')} AS forced, CASE WHEN page_id%5=0 THEN 4 WHEN page_id%3=0 THEN 2 ELSE 3 END AS cap FROM l),
 b AS (SELECT *, row_number() OVER (PARTITION BY page_id, forced ORDER BY i) AS rn FROM f)
SELECT page_id, link, forced FROM b WHERE forced OR rn<=cap""")
def _(spark, d):
    k = F.col("page_id")
    p = wide(spark, d, "pages").withColumns({
        "archetype": F.when(k % 3 == 0, "incomplete_event").otherwise("simple_page"), "confidence": F.lit(0.7), "whitelisted": k % 5 == 0,
    })
    roots = table(spark, d, "region").select(F.concat(F.lit("https://"), F.lower("r_name"), F.lit(".example")).alias("root"))
    return op.link_frontier(p, roots, "page_id", 4).select("page_id", "link", "forced")


@query("migrate_review_rows", "SELECT doc_id AS row_id, CAST(quality AS VARCHAR) AS human_label, 'legacy' AS source_file, '' AS review_notes FROM labels")
def _(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return op.migrate_review(rows, {"doc_id": "row_id", "label": "human_label"}, {"source_file": "legacy", "review_notes": ""})
