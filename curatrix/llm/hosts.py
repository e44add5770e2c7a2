"""URL filters: rules, and Empirical-Bayes reputation of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

# Second-level labels below which domains are registered in two-letter zones.
ZONE_LABELS = ("co", "com", "net", "org", "gov", "edu", "ac")
#: Standard deviations of the posterior between its mean and the bound, and the largest bad share that passes.
DEVIATIONS, MOST_BAD = 1.64, 0.5


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Last label, with the label before it where domains are registered below both."""
    two = F.regexp_extract(host, rf"((?:{'|'.join(ZONE_LABELS)})\.[a-z]{{2}})$", 1)
    return F.when(two != "", two).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def domain_of(host: Column, suffix: Column) -> Column:
    """One label more than the suffix; the host itself if it has none."""
    head = F.substring(host, F.lit(1), F.greatest(F.lit(0), F.length(host) - F.length(suffix) - 1))
    last = F.regexp_extract(head, r"([^.]*)$", 1)
    return F.when(head == "", host).otherwise(F.concat_ws(".", last, suffix))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest of ``rules`` (verdict, host, path) that fits; null without one.

    A rule fits its host and all subdomains if the path starts with the rule's. Rules are
    a short list given by the caller, tried from the longest on.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def shrinkage(nodes: DataFrame) -> float:
    """Prior strength (a + b) of nodes around their parents' means, by moments.

    ``nodes`` has ``bad``, ``total`` and ``prior``. The spread beyond the binomial gives
    the correlation rho within nodes; the strength is 1 / rho - 1. Terms are rounded so
    that the sum does not depend on the order of rows.
    """
    spread = (F.col("bad") - F.col("total") * F.col("prior")) ** 2 - F.col("total") * F.col("prior") * (1 - F.col("prior"))
    scale = F.col("total") * (F.col("total") - 1) * F.col("prior") * (1 - F.col("prior"))
    sums = nodes.agg(F.sum(F.round(spread, 6).cast("decimal(30,6)")).alias("a"), F.sum(F.round(scale, 6).cast("decimal(30,6)")).alias("b")).first()
    rho = float(sums.a) / float(sums.b) if sums.b else 0.5
    rho = min(0.99, max(0.01, rho))
    return 1 / rho - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, mean, deviation, strength): posterior share of bad pages of each host with an outcome or without.

    ``outcomes`` has ``host``, ``domain``, ``suffix`` and ``bad`` (1, 0 or null for pages
    without label). Beta-binomial priors go down from all pages to suffix, registered
    domain and host: a node's prior mean is its parent's posterior mean, and the strength
    of each level comes from how its nodes spread.
    """
    hosts = stored(outcomes.groupBy("suffix", "domain", "host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("total")), "hosts")
    whole = hosts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    mean = (whole.bad + 1) / (whole.total + 2)
    above, keys = None, []
    for key in ("suffix", "domain", "host"):
        keys.append(key)
        level = hosts.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
        level = level.withColumn("prior", F.lit(mean)) if above is None else level.join(above, keys[:-1])
        level = stored(level, "reputation")
        strength = shrinkage(level.filter("total > 0"))
        above = level.withColumn("_mean", (F.col("prior") * strength + F.col("bad")) / (strength + F.col("total"))).withColumn("_n", strength + F.col("total"))
        last = above
        above = above.select(*keys, F.col("_mean").alias("prior"))
    deviation = F.sqrt(F.col("_mean") * (1 - F.col("_mean")) / (F.col("_n") + 1))
    return last.select("host", F.col("_mean").alias("mean"), deviation.alias("deviation"), F.col("_n").alias("strength"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad", deviations: float = DEVIATIONS, most_bad: float = MOST_BAD) -> DataFrame:
    """Verdict on each url: the longest rule that fits, else the reputation of its host.

    ``outcomes`` (``id_col``, ``bad_col`` 0/1) labels some of the pages. A host is blocked
    when the lower bound of its posterior share of bad pages, ``deviations`` standard
    deviations below the mean, is above ``most_bad``: a host with few outcomes keeps near
    its domain's share and needs more evidence.

    Returns per page: ``page_id``, ``host``, ``path``, ``rule`` (null without one),
    ``verdict`` (allow or block), ``bad_share`` (posterior mean), ``bound``.

    * A null url, or one without ``://``, has an empty host and path; all of those share
      one reputation. Labels other than 0 and 1, and those of unknown pages, count nothing;
      of repeated labels of a page the larger counts.
    * Repeated pages are judged and counted each; null ids are judged, but have no label.
    """
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(F.col(url_col).cast("string")).alias("host"), url_path(F.col(url_col).cast("string")).alias("path"))
    labelled = outcomes.select(F.col(id_col).cast("long").alias("_id"), F.col(bad_col).cast("int").alias("bad")).filter("_id is not null and bad in (0, 1)").groupBy("_id").agg(F.max("bad").alias("bad"))
    named = parts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    marked = named.join(labelled, named["page_id"] == labelled["_id"], "left").select("host", "domain", "suffix", "bad")
    known = stored(reputation(marked), "reputation").withColumnRenamed("host", "_host")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    bound = F.greatest(F.lit(0.0), F.col("mean") - deviations * F.col("deviation"))
    own = F.when(bound > most_bad, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(known, parts["host"] == known["_host"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("mean").alias("bad_share"), bound.alias("bound")
    )
