"""Top-k, sampling and set operators."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u
from .keyed import top_per_key


def link_score(c: Column | str) -> Column:
    """Crawl priority of a link by its words."""
    low = F.lower(tx.col(c))
    return (
        F.when(tx.contains_any(low, ("calendar", "events", "event", "schedule", "social", "month", "list")), 5).otherwise(0)
        + F.when(tx.contains_any(low, ("calendar.google.com", "@group.calendar.google.com", "%40group.calendar.google.com")), 8).otherwise(0)
        + F.when(low.contains("/events/"), 4).otherwise(0)
    )


def link_priority(links: DataFrame, page: str, k: int) -> DataFrame:
    """At most ``k`` links per page, best score first, page order on ties."""
    return top_per_key(links.withColumn("score", link_score("link")), [page], [F.desc("score"), F.asc("pos")], k)


def near_future_sample(df: DataFrame, day: str, as_of: Column, n: int, seed: str, key: str, low: int = 7, high: int = 21) -> DataFrame:
    """Repeatable random sample of rows in the coming weeks, ordered by a seeded hash of the key."""
    near = df.filter(F.col(day).between(F.date_add(as_of, low), F.date_add(as_of, high)))
    return near.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).limit(n)


def recent_messages(df: DataFrame, conversation: str, turn: str, k: int) -> DataFrame:
    return top_per_key(df, [conversation], [F.desc(turn)], k).drop("rn")


def one_per_domain(df: DataFrame, url: str, key: str, n: int, excluded_hosts: Sequence[str] = ()) -> DataFrame:
    """First row of each host, calendar hosts left out, up to ``n`` hosts."""
    hosted = df.withColumn("domain", u.host(url)).filter(F.col("domain") != "")
    for h in excluded_hosts:
        hosted = hosted.filter(~F.col("domain").contains(h))
    first = hosted.groupBy("domain").agg(F.min(key).alias(key))
    return first.orderBy("domain").limit(n)


def balanced_pick(df: DataFrame, label: str, key: str, true_limit: int, false_limit: int) -> DataFrame:
    """Equally many true and false rows: the smaller of both limits and both supplies."""
    cap = min(true_limit, false_limit)
    picked = top_per_key(df.filter(F.col(label).isNotNull()), [label], [F.asc(key)], cap)
    supply = picked.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.when(F.count(F.lit(1)) == 2, F.min("n")).otherwise(0).alias("_pairs")
    )
    return picked.join(F.broadcast(supply)).filter(F.col("rn") <= F.col("_pairs")).drop("rn", "_pairs")


def capped_promotion(
    queue: DataFrame, training: DataFrame, excluded: DataFrame, order: Sequence[Column], max_promotions: int = 10, cap: int = 3
) -> DataFrame:
    """Queue rows with ``outcome``: promoted, or the first reason against it.

    ``queue``: url, archetype, training_eligible plus the order columns. ``training``: url,
    archetype. ``excluded``: url. The cap per (domain, archetype) counts stored rows too.
    """
    known = training.select(u.url_eval_key("url").alias("_k")).distinct().withColumn("_known", F.lit(True))
    held = excluded.select(u.url_eval_key("url").alias("_x")).distinct().withColumn("_held", F.lit(True))
    stored = training.groupBy(u.netloc("url").alias("_sd"), F.col("archetype").alias("_sa")).agg(F.count(F.lit(1)).alias("_stored"))
    q = queue.withColumns({"_key": u.url_eval_key("url"), "_dom": u.netloc("url")})
    q = q.join(known, q["_key"] == known["_k"], "left").join(held, q["_key"] == held["_x"], "left")
    mail = F.col("url").contains("@") & ~F.col("url").contains("/")
    reason = (
        F.when(tx.blank("url"), "missing_url").when(mail, "email_like_input_excluded").when(F.col("_held"), "evaluation_url_excluded")
        .when(F.col("_known"), "duplicate_url").when(~F.col("training_eligible"), "not_training_eligible")
        .when(tx.blank("archetype"), "missing_recommended_archetype")
    )
    q = q.withColumn("_why", reason).drop("_k", "_known", "_x", "_held")
    open_rows = q.filter(F.col("_why").isNull()).join(
        stored, (F.col("_dom") == F.col("_sd")) & (F.col("archetype") == F.col("_sa")), "left"
    )
    within = top_per_key(open_rows, ["_dom", "archetype"], order, cap).filter(
        F.col("rn") + F.coalesce("_stored", F.lit(0)) <= cap
    )
    taken = within.orderBy(*order).limit(max_promotions).select(F.col("url").alias("_t")).withColumn("_taken", F.lit(True))
    fits = within.select(F.col("url").alias("_w")).withColumn("_fits", F.lit(True))
    out = q.join(taken, q["url"] == taken["_t"], "left").join(fits, q["url"] == fits["_w"], "left")
    return out.withColumn(
        "outcome",
        F.coalesce("_why", F.when(F.col("_taken"), "promoted").when(F.col("_fits"), "promotion_limit_reached").otherwise("domain_archetype_cap_reached")),
    ).drop("_key", "_dom", "_why", "_t", "_taken", "_w", "_fits")


def image_score(url: Column | str, width: Column, height: Column) -> Column:
    """Poster likelihood of an image by host, path, area and aspect."""
    h, p = u.netloc(url), F.lower(u.path(url))
    times = lambda n: F.lit(Decimal(n))  # noqa: E731  exact, so that a side just at a limit counts
    junk = h.contains("static.cdninstagram.com") | p.contains("/rsrc.php/") | p.endswith("/rsrc.php")
    area = F.least(F.lit(40), F.floor(F.greatest(F.lit(0), width * height) / 50000))
    aspect = (
        F.when((height >= width * times("1.1")) & (height <= width * times("2.3")), 25)
        .when((width >= height * times("0.85")) & (width <= height * times("1.2")), 12)
        .when((width >= height * times("2.0")) | (height >= width * times("3.0")), -30).otherwise(0)
    )
    score = F.when(h.contains("fbcdn.net"), 120).when(h.contains("cdninstagram.com"), 90).otherwise(0)
    score = score + F.when(p.contains("/v/t51"), 35).otherwise(0) + area + aspect
    return F.when(junk, -1000).otherwise(score).cast("long")


def rank_images(df: DataFrame, page: str, url: str, width: str, height: str, key: str, n: int) -> DataFrame:
    scored = df.withColumn("score", image_score(url, F.col(width), F.col(height)))
    return top_per_key(scored, [page], [F.desc("score"), F.asc(key)], n)


def merge_seeds(*lists: DataFrame, link: str = "link") -> DataFrame:
    """Union of seed lists; for one comparison key the earlier list wins, then the smaller link."""
    tagged = [d.withColumn("_list", F.lit(i)) for i, d in enumerate(lists)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    cols = [c for c in union.columns if c != "_list"]
    keyed = union.filter(~tx.blank(link)).withColumn("_k", u.url_compare_key(link))
    best = keyed.groupBy("_k").agg(F.min_by(F.struct(*cols), F.struct("_list", link)).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


def in_all_latest_runs(df: DataFrame, run: str, key: str, n: int) -> DataFrame:
    """Keys present in every one of the latest ``n`` runs; none when there are fewer runs.

    Same as intersecting the runs, with two shuffles whatever ``n`` is.
    """
    recent = df.select(run).distinct().orderBy(F.desc(run)).limit(n)
    hits = df.join(F.broadcast(recent), run).select(run, key).distinct()
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n).select(key)


def new_domains(df: DataFrame, url: str, watch: DataFrame, watch_url: str) -> DataFrame:
    seen = df.select(u.host(url).alias("domain")).filter("domain <> ''").distinct()
    known = watch.select(u.host(watch_url).alias("domain")).distinct()
    return seen.join(known, "domain", "left_anti")


def eval_split(df: DataFrame, key: str, dev: DataFrame, holdout: DataFrame, list_key: str, active: str = "active") -> DataFrame:
    """Adds ``split``: holdout, dev or train. Inactive list rows are ignored."""
    def load(rows, tag):
        on = ~F.lower(tx.text(active)).isin("false", "0", "no", "n")
        return rows.filter(on & ~tx.blank(list_key)).select(F.col(list_key).alias(f"_{tag}")).distinct().withColumn(f"_in_{tag}", F.lit(True))

    h, v = load(holdout, "hold"), load(dev, "dev")
    j = df.join(h, df[key] == h["_hold"], "left").join(v, df[key] == v["_dev"], "left")
    return j.withColumn("split", F.when(F.col("_in_hold"), "holdout").when(F.col("_in_dev"), "dev").otherwise("train")).drop(
        "_hold", "_in_hold", "_dev", "_in_dev"
    )
