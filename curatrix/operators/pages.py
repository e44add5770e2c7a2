"""Page classification: URL and text rules, structural score, and a trained model."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u
from ..functions.html import html_stats
from .gates import EVENT_SIGNALS, has_event_signal
from .keyed import top_per_key, with_group_agg
from .normalize import hrefs, page_links, visible_text_native
from .selection import link_score

# Words and URL parts of event pages.
TICKET_TOKENS = ("ticket", "tickets", "register", "registration", "buy", "admission", "eventbrite")
EVENT_LINK_HINTS = ("/event/", "/events/", "/show/", "/calendar/event", "-tickets-", "/nm_event/")
DETAIL_HINTS = ("/event/", "/events/", "/show/", "/tickets/", "/nm_event/")
NOT_DETAIL = ("/events/month", "/events/list", "/calendar", "/schedule", "/upcoming")
LISTING_PATHS = ("/calendar", "/events", "/upcoming", "/schedule", "/list", "/month")
LISTING_QUERIES = ("month_limit=", "year_limit=", "view=list", "view=month", "calendar")
LISTING_WORDS = ("view all", "load more", "more events", "upcoming events", "read more", "learn more", "tickets")
SCORED_LISTING_WORDS = ("view all", "load more", "more events", "upcoming events", "calendar", "list view", "month view")
MONTH_WORDS = (
    r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|"
    r"october|november|december)\b"
)
WEEKDAY_WORDS = r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
TIME_WORDS = r"\b\d{1,2}(?::\d{2})?\s?(?:am|pm)\b|\b\d{1,2}:\d{2}\b"
ADDRESS_WORDS = (
    r"\b\d{1,6}\s+[a-z0-9.' -]{1,80}\s(?:st|street|ave|avenue|rd|road|dr|drive|blvd|boulevard|ln|lane|way|hwy|highway)\b"
)
EMAIL_WORDS = r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
EVENT_TYPES_LD = "event|musicevent|danceevent|educationevent|festival"


HIDDEN_PARTS = r"(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>"


def html_features(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Twelve page features: schema markup, address, time, date, ticket and detail links, cards, text score.

    Counts over text and links are patterns in the JVM; only the card count, which needs
    element classes, goes through the parser UDF.
    """
    low = F.lower(F.col("_text"))

    def count(pattern, c=low):
        return F.regexp_count(c, F.lit(pattern))

    links = hrefs(F.lower(F.col(html)))
    anchors = F.regexp_extract_all(F.regexp_replace(F.lower(F.col(html)), HIDDEN_PARTS, " "), F.lit(r"(?s)<a\s[^>]*href[^>]*>(.*?)</a>"), F.lit(1))
    texts = F.transform(anchors, lambda a: F.regexp_replace(a, "<[^>]*>", " "))

    def links_with(tokens, parts="_links"):
        return F.size(F.filter(parts, lambda h: tx.contains_any(h, tokens)))

    score = (
        2 * count("ticket|register|venue|location") + 2 * count("tickets") + count("event|dance|class|workshop|lesson|social") + count("events")
        + count(MONTH_WORDS) + count(WEEKDAY_WORDS) + F.when(tx.contains_any(F.lower(F.col(url)), EVENT_LINK_HINTS), 2).otherwise(0)
    )
    schema = count(rf'(?i)"@type"\s*:\s*(?:"(?:{EVENT_TYPES_LD})"|\[[^\]]*"(?:{EVENT_TYPES_LD})")', F.col(html))
    base = pages.withColumns({"_text": visible_text_native(html), "_links": links, "_texts": texts, "_stats": html_stats(html)})
    feats = base.withColumns({
        "schema_event_count": schema, "address_count": count(ADDRESS_WORDS), "time_count": count(TIME_WORDS),
        "date_count": count(MONTH_WORDS) + count(WEEKDAY_WORDS), "ticket_link_count": links_with(TICKET_TOKENS) + links_with(TICKET_TOKENS, "_texts"),
        "event_detail_link_count": links_with(EVENT_LINK_HINTS),
        "map_embed_present": F.lower(F.col(html)).rlike(r'(?:src|href)="[^"]*(?:google\.com/maps|maps\.google)'),
        "mailto_present": F.lower(F.col(html)).contains('href="mailto:') | low.rlike(EMAIL_WORDS),
        "listing_card_count": F.col("_stats.cards"), "visible_text_event_score": score,
    })
    single = (
        (F.col("date_count") >= 1) & (F.col("time_count") >= 1) & (F.col("address_count") >= 1)
        & (F.col("listing_card_count") <= 1) & (F.col("event_detail_link_count") <= 2)
    )
    return feats.withColumns({"schema_event_present": F.col("schema_event_count") > 0, "single_event_signal": single}).drop("_text", "_links", "_texts", "_stats")


def _host_is(c, name: str) -> Column:
    h = u.host(c)
    return (h == name) | h.endswith("." + name)


def is_detail_url(c: Column | str, hints: Iterable[str] = DETAIL_HINTS) -> Column:
    low, p = F.lower(tx.text(c)), F.lower(u.path(c))
    no = F.regexp_replace(p, "/+$", "").endswith("/events") | tx.contains_any(p, NOT_DETAIL)
    return ~no & (tx.contains_any(low, hints) | low.rlike("/event(?:[/?#]|$)"))


def is_listing_url(c: Column | str, paths: Iterable[str] = LISTING_PATHS, hints: Iterable[str] = DETAIL_HINTS) -> Column:
    hit = tx.contains_any(F.lower(u.path(c)), paths) | tx.contains_any(F.lower(u.query(c)), LISTING_QUERIES)
    return ~is_detail_url(c, hints) & hit


def is_calendar_url(c: Column | str) -> Column:
    return tx.contains_any(F.lower(tx.text(c)), (
        "calendar.google.com", "google.com/calendar", "@group.calendar.google.com", "%40group.calendar.google.com", "/calendar/ical/"))


def classify_rules(
    url: Column | str, body: Column, links: Column, calendars: Column | None = None, detail_hints: Iterable[str] = DETAIL_HINTS,
    listing_paths: Iterable[str] = LISTING_PATHS, signals: Iterable[str] = EVENT_SIGNALS, listing_words: Iterable[str] = LISTING_WORDS,
) -> Column:
    """Struct (archetype, owner_step, subtype) from ordered URL and text rules."""
    calendars = F.lit(0) if calendars is None else calendars
    t, low = tx.text(url), F.lower(body)
    fb, ig = _host_is(url, "facebook.com"), _host_is(url, "instagram.com")
    eb = u.host(url).contains("eventbrite.")
    listing_text = tx.contains_any(low, listing_words)
    detail = is_detail_url(url, detail_hints)
    fallback = (
        F.when(is_listing_url(url, listing_paths, detail_hints) | (links >= 3) | (listing_text & (links >= 6)), "incomplete_event")
        .when(tx.contains_any(low, signals), "simple_page").otherwise("other")
    )
    rules = [
        (t.rlike(r"(?i)^[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}$"), "other", "emails.py", "email_input"),
        (is_calendar_url(url) | (calendars > 0), "google_calendar", "scraper.py", "google_calendar"),
        (fb & u.path(url).rlike(r"/events/\d+"), "complicated_page", "fb.py", "facebook_event_detail"),
        (ig & F.lower(u.path(url)).rlike("^/(p|reel|tv)/[^/]+"), "complicated_page", "fb.py", "instagram_post_detail"),
        (fb | ig, "complicated_page", "fb.py", "social_listing_or_profile"),
        (eb & u.path(url).rlike(r"-tickets-\d+"), "simple_page", "ebs.py", "eventbrite_event_detail"),
        (eb & u.path(url).rlike("^/o/[^/]+/?$"), "incomplete_event", "ebs.py", "eventbrite_organizer"),
        (detail, "simple_page", "scraper.py", "event_detail"),
    ]
    out = F.struct(fallback.alias("archetype"), F.lit("scraper.py").alias("owner_step"), fallback.alias("subtype"))
    for cond, arch, owner, sub in reversed(rules):
        out = F.when(cond, F.struct(F.lit(arch).alias("archetype"), F.lit(owner).alias("owner_step"), F.lit(sub).alias("subtype"))).otherwise(out)
    return out


RULE_SUBTYPES = (
    "google_calendar", "facebook_event_detail", "instagram_post_detail", "social_listing_or_profile", "eventbrite_event_detail",
    "eventbrite_organizer", "event_detail",
)


def classify_scored(df: DataFrame, body: str, links: str, predicted: str | None = None, listing_paths=LISTING_PATHS, signals=EVENT_SIGNALS,
                    listing_words=SCORED_LISTING_WORDS, rule: str = "rule") -> DataFrame:
    """Adds archetype, confidence and stage: rule .99, model from .70, structural score, fallback .52.

    ``rule`` is the struct of :func:`classify_rules`; ``predicted`` an optional struct with
    archetype, owner_step, archetype_confidence and owner_confidence.
    """
    low, n, r = F.lower(F.col(body)), F.col(links), F.col(rule)
    months = F.lit(0)
    for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"):
        months = months + F.regexp_count(low, F.lit(m))
    score = (
        F.when(is_listing_url("url", listing_paths), 3).otherwise(0) + F.when(n >= 3, 2).otherwise(0)
        + F.when(tx.contains_any(low, listing_words), 1).otherwise(0) + F.when(months >= 4, 1).otherwise(0)
    )
    base = df.withColumns({"listing_score": score, "event_signal": has_event_signal(body, signals)})
    s = F.col("listing_score")
    by_rule = r["subtype"].isin(*RULE_SUBTYPES)
    by_model = F.lit(False) if predicted is None else F.coalesce(F.col(f"{predicted}.archetype_confidence") >= 0.70, F.lit(False))
    model_arch = F.lit(None).cast("string") if predicted is None else F.col(f"{predicted}.archetype")
    model_conf = F.lit(None).cast("double") if predicted is None else F.col(f"{predicted}.archetype_confidence")
    return base.withColumns({
        "archetype": F.when(by_rule, r["archetype"]).when(by_model, model_arch).when((s < 3) & F.col("event_signal"), r["archetype"]).otherwise("incomplete_event"),
        "confidence": F.when(by_rule, 0.99).when(by_model, model_conf).when(s >= 3, F.least(0.70 + 0.05 * F.least(s, F.lit(4)), F.lit(0.90)))
        .when(F.col("event_signal"), F.when(n <= 2, 0.68).otherwise(0.60)).otherwise(0.52),
        "stage": F.when(by_rule, "rule").when(by_model, "ml").otherwise("structural"),
    })


def apply_routing_memory(decisions: DataFrame, memory: DataFrame, key: str = "url") -> DataFrame:
    """Proven routing overrides a decision that is not a sure rule."""
    m = memory.select(F.col("link").alias("_l"), F.col("archetype").alias("_a"), F.col("avg_confidence").alias("_c"))
    j = decisions.join(m, decisions[key] == m["_l"], "left")
    use = F.col("_a").isNotNull() & ~((F.col("stage") == "rule") & (F.col("confidence") >= 0.95))
    conf = F.least(F.greatest(F.coalesce("_c", "confidence"), "confidence"), F.lit(0.98))
    return j.withColumns({
        "archetype": F.when(use, F.col("_a")).otherwise(F.col("archetype")), "confidence": F.when(use, conf).otherwise(F.col("confidence")),
        "stage": F.when(use, "memory").otherwise(F.col("stage")),
    }).drop("_l", "_a", "_c")


def step_ownership(owner: Column, step: Column, edge_case: Column) -> Column:
    """Struct (allow, reason): whether a step may process a page of this owner."""
    delegated = (step == "rd_ext.py") & edge_case & (owner == "scraper.py")
    reason = F.when(step == owner, "owner_match").when(delegated, "edge_case_delegate_allowed").otherwise(F.concat(F.lit("owned_by_"), owner))
    return F.struct(((step == owner) | delegated).alias("allow"), reason.alias("reason"))


def model_features(df: DataFrame, url: str = "url", families=u.PLATFORM_FAMILIES) -> DataFrame:
    """URL flags, depth and name=value tokens of the template URL."""
    key = u.url_template_key(url, families)
    base = df.withColumn("_u", key)
    dom, p, q = u.netloc("_u"), F.lower(u.path("_u")), F.lower(u.query("_u"))

    def tokens(c, drop, prefix):
        parts = F.filter(F.split(c, "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*drop))
        return F.transform(parts, lambda t: F.concat(F.lit(prefix), t))

    flags = [
        ("path_has_event", p.contains("/event")), ("path_has_calendar", p.contains("calendar") | q.contains("calendar")),
        ("path_has_show", p.contains("/show/")), ("path_has_ticket", p.contains("ticket") | q.contains("ticket")), ("has_query", q != ""),
        ("domain_has_eventbrite", dom.contains("eventbrite")), ("domain_has_facebook", dom.contains("facebook")),
        ("domain_has_instagram", dom.contains("instagram")), ("domain_has_google", dom.contains("google")),
    ]
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in flags]))
    return base.withColumns({
        "url_length": F.length("_u"), "path_depth": F.size(u.path_segments("_u")),
        "tokens": F.array_distinct(F.concat(names, tokens(dom, ("www", "com", "ca", "org", "net"), "domain_token:"), tokens(p, ("html", "php"), "path_token:"))),
    }).drop("_u")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows / (classes * rows of the class)."""
    sized = with_group_agg(df, [label], _n=F.count(F.lit(1)))
    totals = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return sized.join(F.broadcast(totals)).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def train_classifier(df: DataFrame, label: str, tokens: str = "tokens", buckets: int = 1 << 14, max_iter: int = 30) -> tuple[PipelineModel, StringIndexerModel]:
    """Balanced one-vs-rest logistic model over hashed tokens; the caller drops held-out rows first.

    Hashing keeps the feature width fixed however many tokens there are.
    """
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df)
    rows = balanced_weights(indexer.transform(df), "_y")
    tf = HashingTF(inputCol=tokens, outputCol="_x", numFeatures=buckets, binary=True)
    lr = LogisticRegression(maxIter=max_iter, regParam=0.01, rawPredictionCol="_raw", weightCol="weight", featuresCol="_x")
    ovr = OneVsRest(classifier=lr, labelCol="_y", featuresCol="_x", weightCol="weight", rawPredictionCol="_raw", predictionCol="_p")
    return Pipeline(stages=[tf, ovr]).fit(rows), indexer


def predict_classifier(model: PipelineModel, indexer: StringIndexerModel, df: DataFrame) -> DataFrame:
    """Adds predicted label and confidence (largest one-vs-rest probability, normalised over classes)."""
    out = model.transform(df)
    raw = vector_to_array(F.col("_raw"))
    prob = F.transform(raw, lambda m: 1 / (1 + F.exp(-m)))
    total = F.aggregate(prob, F.lit(0.0), lambda acc, v: acc + v)
    labels = F.array(*[F.lit(v) for v in indexer.labels])
    return out.withColumns({
        "predicted": F.get(labels, F.col("_p").cast("int")), "confidence": F.array_max(prob) / total,
    }).drop("_x", "_raw", "_p")


def text_vectors(df: DataFrame, columns: Sequence[str], out: str = "vec", buckets: int = 1 << 12) -> DataFrame:
    """Unit TF-IDF vectors of the concatenated text columns, for rows without a supplied embedding."""
    body = F.concat_ws(" | ", *[tx.text(c) for c in columns])
    words = df.withColumn("_w", F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stages = [
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=buckets), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_n"),
    ]
    return Pipeline(stages=stages).fit(words).transform(words).withColumn(out, F.col("_n")).drop("_w", "_tf", "_idf", "_n")


def link_frontier(pages: DataFrame, roots: DataFrame, key: str, base_limit: int = 10) -> DataFrame:
    """Links to follow per page: forced links, and the best others up to the page's cap.

    ``pages``: key, url, html, archetype, confidence, whitelisted. ``roots``: root. A link
    is forced when it lies under a root, is a calendar, or stays on a whitelisted
    page's host.
    """
    links = page_links(pages.select(key, "url", "html"), key)
    facts = pages.select(F.col(key).alias("_k"), "archetype", "confidence", "whitelisted")
    r = roots.select(u.url_compare_key("root").alias("_r")).distinct().select(u.netloc("_r").alias("_rh"), u.path("_r").alias("_rp"))
    own = links.withColumns({"_lh": u.netloc("link"), "_lp": u.path(u.url_compare_key("link"))})
    under = own.join(r, (F.col("_lh") == F.col("_rh")) & F.startswith("_lp", "_rp"), "left_semi").select(F.col(key).alias("_uk"), F.col("pos").alias("_up")).withColumn("_under", F.lit(True))
    j = own.join(facts, own[key] == facts["_k"]).join(under, (own[key] == F.col("_uk")) & (F.col("pos") == F.col("_up")), "left")
    forced = F.coalesce("_under", F.lit(False)) | is_calendar_url("link") | (F.col("whitelisted") & (F.col("_lh") == u.netloc("url")))
    cap = (
        F.when(F.col("whitelisted") | is_detail_url("url"), base_limit).when(F.col("archetype") == "incomplete_event", 2)
        .when((F.col("archetype") == "simple_page") & (F.col("confidence") < 0.8), 3).otherwise(5)
    )
    scored = j.withColumns({"forced": forced, "_cap": F.least(cap, F.lit(base_limit)), "score": link_score("link")})
    best = top_per_key(scored.filter(~F.col("forced")), [key], [F.desc("score"), F.asc("pos")], base_limit).filter(F.col("rn") <= F.col("_cap")).drop("rn")
    return scored.filter("forced").unionByName(best).select(key, "link", "forced", "score")


def migrate_review(df: DataFrame, mapping: dict[str, str], defaults: dict[str, str]) -> DataFrame:
    """Legacy review rows in the rich schema: renamed columns plus defaults for the new ones."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()], *[F.lit(v).alias(c) for c, v in defaults.items()])
