"""Telemetry and quality aggregates. All are map-side combined group-bys; results are small tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written
from .keyed import top_per_key
from .rules import related_names


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; 0 when there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("counted"))


def hit_ratio(log: DataFrame) -> DataFrame:
    """True/false ratio per link: 0 without a hit, 1 without a miss; plus the sum of tries."""
    good, bad = F.count_if("relevant"), F.count_if(~F.col("relevant"))
    return log.groupBy("link").agg(
        F.when(good == 0, 0.0).when(bad == 0, 1.0).otherwise(F.try_divide(good, bad)).alias("hit_ratio"),
        F.sum("crawl_try").alias("crawl_try"),
    )


def high_performers(log: DataFrame, keys: Sequence[str], min_attempts: int = 3, min_share: float = 0.5) -> DataFrame:
    """Groups with enough attempts whose true share exceeds the limit."""
    g = log.groupBy(*keys).agg(
        F.try_divide(F.count_if("relevant"), F.count(F.lit(1))).alias("hit_ratio"),
        F.count(F.lit(1)).alias("total_attempts"), F.max("time_stamp").alias("last_crawled"),
    )
    return g.filter((F.col("total_attempts") >= min_attempts) & (F.col("hit_ratio") > min_share))


STEP_FLAGS = (
    "access_attempted", "access_succeeded", "text_extracted", "keywords_found", "extraction_attempted",
    "extraction_succeeded", "ocr_attempted", "ocr_succeeded", "vision_attempted", "vision_succeeded", "fallback_used",
)


def step_name(handled_by="handled_by", step="step_name") -> Column:
    """handled_by without '.py', else the step's own name."""
    return F.coalesce(F.nullif(F.replace(tx.text(handled_by), F.lit(".py"), F.lit("")), F.lit("")), tx.filled(step))


def step_telemetry(metrics: DataFrame) -> DataFrame:
    """Counts and success rates per scraping step."""
    g = metrics.groupBy(step_name().alias("step")).agg(
        F.count(F.lit(1)).alias("total_urls"),
        *[F.count_if(f).alias(f"{f}_count") for f in STEP_FLAGS],
        F.count_if(F.col("events_written") > 0).alias("urls_with_events_count"),
        F.coalesce(F.sum("events_written"), F.lit(0)).alias("events_written_total"),
    )
    c = F.col
    return g.withColumns({
        "access_success_rate_pct": pct(c("access_succeeded_count"), c("access_attempted_count")),
        "text_extracted_rate_pct": pct(c("text_extracted_count"), c("access_attempted_count")),
        "keyword_hit_rate_pct": pct(c("keywords_found_count"), c("text_extracted_count")),
        "extraction_success_rate_pct": pct(c("extraction_succeeded_count"), c("extraction_attempted_count")),
        "ocr_success_rate_pct": pct(c("ocr_succeeded_count"), c("ocr_attempted_count")),
        "vision_success_rate_pct": pct(c("vision_succeeded_count"), c("vision_attempted_count")),
        "fallback_usage_rate_pct": pct(c("fallback_used_count"), c("extraction_attempted_count")),
    })


def step_integrity(metrics: DataFrame, writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """Per step: events reported, rows attributed, deletes; WARN on a mismatch, FAIL on unknown reasons."""
    def norm(c):
        return F.regexp_replace(F.lower(tx.text(c)), r"\.py$", "")

    m = metrics.groupBy(norm(step_name()).alias("step")).agg(F.sum("events_written").alias("metrics_events"))
    w = writes.groupBy(norm("step_name").alias("step")).agg(F.count(F.lit(1)).alias("write_rows"))
    x = deletes.groupBy(norm("step_name").alias("step")).agg(
        F.count(F.lit(1)).alias("delete_rows"), F.count_if(~F.col("reason_registered")).alias("unknown_reasons")
    )
    out = m.join(w, "step", "full_outer").join(x, "step", "full_outer").fillna(0).filter(F.col("step") != "")
    return out.withColumn("delta", F.col("metrics_events") - F.col("write_rows")).withColumn(
        "status", F.when(F.col("unknown_reasons") > 0, "FAIL").when(F.col("delta") != 0, "WARN").otherwise("PASS")
    )


def duplicate_attribution(writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows beyond one per event in each attribution table.

    Counted per event first, so no task has to hold a distinct set.
    """
    def extra(df, kind):
        per_event = df.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
        return per_event.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")).select(
            F.lit(kind).alias("table"), "duplicate_rows"
        )

    return extra(writes, "write").unionByName(extra(deletes, "delete"))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent values with their share of all rows."""
    counts = count_by(df, column)
    total = counts.agg(F.sum("counted").alias("_total"))
    top = counts.orderBy(F.desc("counted"), F.asc(column)).limit(k)
    return top.join(F.broadcast(total)).withColumn("share_pct", pct(F.col("counted"), F.col("_total"))).drop("_total")


def source_presence(df: DataFrame, column: str, required: DataFrame, name: str = "required_source") -> DataFrame:
    """Each required source with the rows of the sources whose name contains it or is contained in it."""
    counts = count_by(df, column)
    names = required.select(name).distinct()
    related = related_names(counts.filter(F.col(column).isNotNull()), column, names, name)
    found = related.join(counts, column).groupBy(name).agg(F.sum("counted").alias("rows"))
    return names.join(found, name, "left").withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("present", F.col("rows") > 0)


def total_range(df: DataFrame, low: int, high: int) -> DataFrame:
    n = F.col("total_events")
    return df.agg(F.count(F.lit(1)).alias("total_events")).withColumn(
        "status", F.when((n < low) | (n > high), "WARNING").otherwise("PASS")
    )


def source_alerts(history: DataFrame, current_run, lookback: int = 14, min_baseline: float = 5, drop: float = 0.6, spike: float = 1.0, top: int = 10) -> DataFrame:
    """Drop, dropout and spike of sources against their mean over the latest earlier runs.

    ``history``: run_id, run_ts, source, event_count (current run included).
    """
    runs = history.filter(F.col("run_id") != current_run).select("run_id", "run_ts").distinct()
    recent = runs.orderBy(F.desc("run_ts")).limit(lookback).select("run_id")
    base = (
        history.join(F.broadcast(recent), "run_id").groupBy("source").agg(F.avg("event_count").alias("baseline_avg"))
        .filter(F.col("baseline_avg") >= min_baseline).orderBy(F.desc("baseline_avg"), F.asc("source")).limit(top)
    )
    cur = history.filter(F.col("run_id") == current_run).select("source", F.col("event_count").alias("current_count"))
    change = (F.col("current_count") - F.col("baseline_avg")) / F.greatest(F.lit(1.0), F.col("baseline_avg"))
    joined = base.join(cur, "source", "left").fillna(0, ["current_count"]).withColumn("pct_change", change)
    kind = (
        F.when(F.col("current_count") == 0, "dropout").when(F.col("pct_change") <= -abs(drop), "drop")
        .when(F.col("pct_change") >= abs(spike), "spike")
    )
    return joined.withColumn("alert_type", kind).filter(F.col("alert_type").isNotNull()).withColumn(
        "severity", F.when(F.col("alert_type") == "dropout", "critical").otherwise("warning")
    )


# Mismatch categories that point at the page classifier, and those that do not.
CLASSIFIER_CATEGORIES = ("no_event_extracted_replay", "content_drift_major")
OTHER_CATEGORIES = (
    "wrong_date", "wrong_time", "wrong_location_or_address", "wrong_source", "duplicate_event_identity",
    "url_unreachable_replay", "social_platform_scraper_init_failed", "parser_or_llm_failure", "missing_url_baseline", "other_mismatch",
)


def training_queue(replay: DataFrame, labels: DataFrame, review_categories=CLASSIFIER_CATEGORIES, other_categories=OTHER_CATEGORIES) -> DataFrame:
    """Per URL: match counts, mismatch categories, status and a priority by label scarcity.

    ``replay``: url, is_match, mismatch_category, archetype, owner_step.
    ``labels``: reviewed_archetype, reviewed_owner (one row per reviewed page).
    """
    per_cat = replay.groupBy("url", "is_match", F.coalesce(tx.filled("mismatch_category"), F.lit("unknown")).alias("cat")).agg(
        F.count(F.lit(1)).alias("n"), F.min("archetype").alias("archetype"), F.min("owner_step").alias("owner_step")
    )
    bad = ~F.col("is_match")
    g = per_cat.groupBy("url").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("is_match"), F.col("n"))), F.lit(0)).alias("true_count"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("false_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(bad, F.struct("cat", "n"))))).alias("category_counts"),
        F.coalesce(F.bool_and(F.when(bad, F.col("cat").isin(*review_categories))), F.lit(False)).alias("_review"),
        F.coalesce(F.bool_and(F.when(bad, F.col("cat").isin(*other_categories))), F.lit(False)).alias("_other"),
        F.min("archetype").alias("archetype"), F.min("owner_step").alias("owner_step"),
    )
    t, f = F.col("true_count"), F.col("false_count")
    status = (
        F.when((t > 0) & (f == 0), "auto_positive_candidate")
        .when((t == 0) & (f > 0) & F.col("_review"), "classifier_review_needed")
        .when((t == 0) & (f > 0) & F.col("_other"), "extraction_issue")
        .when((t > 0) & (f > 0), "mixed_signal")
        .otherwise("manual_review_needed")
    )

    def gaps(column, out):
        counts = labels.filter(~tx.blank(column)).groupBy(F.col(column).alias(f"_{out}")).agg(F.count(F.lit(1)).alias(f"_{out}_n"))
        top = counts.agg(F.coalesce(F.max(f"_{out}_n"), F.lit(0)).alias(f"_{out}_max"))
        return counts, F.broadcast(top)

    arch, arch_max = gaps("reviewed_archetype", "arch")
    own, own_max = gaps("reviewed_owner", "own")
    bonus = (
        F.when(F.col("status") == "auto_positive_candidate", 100).when(F.col("status") == "classifier_review_needed", 60)
        .when(F.col("status") == "mixed_signal", 30).when(F.col("status") == "manual_review_needed", 20).otherwise(0)
    )
    gap = (F.col("_arch_max") - F.coalesce("_arch_n", F.lit(0))) * 3 + (F.col("_own_max") - F.coalesce("_own_n", F.lit(0))) * 2
    return (
        g.withColumn("status", status)
        .join(arch, g["archetype"] == F.col("_arch"), "left").join(own, g["owner_step"] == F.col("_own"), "left")
        .join(arch_max).join(own_max)
        .withColumns({
            "priority_score": (bonus + gap).cast("long"), "match_rate_pct": pct(t, F.col("total_rows")),
            "training_eligible": F.col("status") == "auto_positive_candidate",
        })
        .select("url", "total_rows", "true_count", "false_count", "match_rate_pct", "category_counts", "status",
                "training_eligible", "priority_score", "archetype", "owner_step")
    )


def queue_order() -> list[Column]:
    """Deterministic review order of the training queue."""
    return [F.desc("priority_score"), F.col("status") != "auto_positive_candidate", F.desc("false_count"), F.asc("url")]


def field_accuracy(pairs: DataFrame, fields: dict[str, Column], eligible: dict[str, Column]) -> DataFrame:
    """Match percentage per field over the rows whose baseline is filled."""
    out = pairs.agg(*[
        F.coalesce(F.round(F.avg(F.when(eligible[f], m.cast("double"))) * 100, 2), F.lit(0.0)).alias(f) for f, m in fields.items()
    ])
    return out.unpivot([], list(fields), "field", "accuracy_pct")


def domain_accuracy(replay: DataFrame, url: str, domain: str, match: str) -> DataFrame:
    """A URL succeeds when all its rows match; share of succeeding URLs per domain."""
    urls = replay.groupBy(domain, url).agg(F.bool_and(match).alias("ok"))
    return urls.groupBy(domain).agg(
        F.count(F.lit(1)).alias("urls"), F.count_if("ok").alias("success_urls"),
        F.round(F.avg(F.col("ok").cast("double")) * 100, 2).alias("accuracy_pct"),
    )


def best_and_worst(domains: DataFrame, domain: str, k: int) -> DataFrame:
    best = domains.orderBy(F.desc("accuracy_pct"), F.asc(domain)).limit(k).withColumn("side", F.lit("best"))
    worst = domains.orderBy(F.asc("accuracy_pct"), F.asc(domain)).limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def quality_rates(df: DataFrame, invalid: Column, stale: Column) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        pct(F.count_if(invalid), F.count(F.lit(1))).alias("invalid_pct"),
        pct(F.count_if(stale), F.count(F.lit(1))).alias("stale_pct"),
    )


def stage_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy and mean confidence per (stage, domain) with subtotals in one pass."""
    return df.rollup("stage", "domain").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("success").cast("double")) * 100, 2).alias("accuracy_pct"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


PROVIDERS = ("openai", "openrouter", "mistral", "gemini")


def provider_activity(lines: DataFrame, start: Column, end: Column, providers: Iterable[str] = PROVIDERS) -> DataFrame:
    """Attempts and outcomes per provider from parsed log lines (ts, line, provider)."""
    low = F.lower("line")
    inside = lines.filter(F.col("ts").between(start, end)).filter(F.col("provider").isin(*providers))
    failed = low.contains("query failed")
    return inside.groupBy("provider").agg(
        F.count_if("is_query").alias("attempts"),
        F.count_if(low.contains("response received")).alias("successes"),
        F.count_if(failed).alias("failures"),
        F.count_if(failed & low.rlike("request timed out|read timed out")).alias("timeouts"),
        F.count_if(failed & low.rlike("status 429|too many requests|rate limit exceeded")).alias("rate_limits"),
    )


# Activity levels that count as pressure (attempts, exhausted, rate limits, timeouts, last fallback).
HIGH_PRESSURE = {"attempts": 150, "exhausted": 10, "rate_limits": 25, "timeouts": 15, "fallback_attempts": 20}
MEDIUM_PRESSURE = {"attempts": 60, "exhausted": 3, "rate_limits": 10, "timeouts": 5, "fallback_attempts": 5}


def pressure_level(totals: DataFrame, high: dict = HIGH_PRESSURE, medium: dict = MEDIUM_PRESSURE) -> DataFrame:
    def any_over(limits):
        out = F.lit(False)
        for c, v in limits.items():
            out = out | (F.col(c) >= v)
        return out

    return totals.withColumn("pressure_level", F.when(any_over(high), "HIGH").when(any_over(medium), "MEDIUM").otherwise("LOW"))


def alias_audit(audit: DataFrame, days: int) -> DataFrame:
    """Counts by day, decision, rule and candidate over the last ``days`` days that occur.

    One scan and one shuffle: the days kept are found on the distinct days, and all four
    groupings come from a single expansion.
    """
    day = F.coalesce(F.to_date("ts").cast("string"), F.lit("unknown"))
    marked = audit.withColumn("day", day)
    present = marked.filter(F.col("day") != "unknown").select("day").distinct().orderBy(F.desc("day")).limit(days)
    kept = marked.join(F.broadcast(present), "day", "left_semi") if days > 0 else marked

    def name(c):
        return F.coalesce(tx.filled(c), F.lit("(blank)"))

    facets = F.array(
        F.struct(F.lit("daily").alias("facet"), F.col("day").alias("key")),
        F.struct(F.lit("decision").alias("facet"), name("decision").alias("key")),
        F.struct(F.lit("rule_decision").alias("facet"), F.concat_ws(" | ", name("rule_name"), name("decision")).alias("key")),
        F.struct(F.lit("candidate").alias("facet"), name("candidate").alias("key")),
    )
    return kept.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.key").agg(F.count(F.lit(1)).alias("n"))


# Where deletes come from.
MODEL_SOURCES = (
    "irrelevant_rows.delete_irrelevant_rows", "dedup_llm.delete_duplicates", "dedup_llm.deduplicate_with_embeddings",
    "dedup_llm.resolve_venue_time_conflicts",
)
CLEANUP_SOURCES = ("db.delete_old_events", "db.delete_likely_dud_events", "db.delete_events_with_nulls")


def suspicious_deletes(audit: DataFrame, end: Column, days: int = 14, top: int | None = 40) -> DataFrame:
    """Score deleted rows by seven signals; the first signal names the category.

    ``audit``: deleted_at, deletion_source, deletion_reason, fuzzy_score and the event's
    event_id, event_name, url, location, dance_style, description, start_date, time_stamp.
    ``top`` is the length of the review report; None returns every flagged row.
    """
    c = F.col
    long_text = F.length(F.trim(F.coalesce("description", F.lit("")))) >= 40
    age = (F.unix_micros(c("deleted_at").cast("timestamp")) - F.unix_micros(c("time_stamp").cast("timestamp"))) / 3.6e9
    model = c("deletion_source").isin(*MODEL_SOURCES)
    weak = (c("deletion_source") == "db.fuzzy_duplicates") & (c("fuzzy_score") < 90)
    future = (c("start_date") >= F.to_date(end)) & c("deletion_source").isin(*CLEANUP_SOURCES)
    local = c("deletion_reason").isin("outside_bc_filter", "outside_canada_filter") & tx.contains_any(
        F.lower(tx.text("location")), ("victoria", "vancouver island", ", bc", "british columbia"))
    dud = (c("deletion_reason") == "empty_source_dance_style_url_no_address") & (~tx.blank("url") | ~tx.blank("dance_style") | long_text)
    other = (c("deletion_reason") == "empty_dance_style_url_other_no_location_description") & ~tx.blank("event_name") & (~tx.blank("url") | long_text)
    rapid = age.between(0, 6)
    signals = [
        (model, 2, "model_driven_delete_requires_review"), (weak, 2, "low_confidence_fuzzy_duplicate"),
        (future, 3, "future_event_deleted_by_cleanup"), (local, 3, "local_looking_location_deleted_as_non_local"),
        (dud, 2, "non_empty_event_deleted_as_empty_dud"), (other, 2, "non_empty_other_deleted_as_empty"),
        (rapid, 1, "rapid_post_ingest_delete"),
    ]
    score = F.lit(0)
    for cond, points, _ in signals:
        score = score + F.when(F.coalesce(cond, F.lit(False)), points).otherwise(0)
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for cond, _, n in signals]))
    window = audit.filter(c("deleted_at").between(end - F.make_interval(days=F.lit(days)), end))
    scored = window.withColumns({"suspicion_score": score, "signals": names}).withColumn(
        "category",
        F.when(F.coalesce(future, F.lit(False)), "future_event_deleted_by_cleanup").otherwise(F.coalesce(F.get("signals", F.lit(0)), F.lit("other_suspicious"))),
    )
    sure = (c("deletion_source") == "db.dedup") | (
        (c("deletion_source") == "db.fuzzy_duplicates") & F.coalesce(c("fuzzy_score") >= 90, F.lit(True)))
    flagged = scored.filter((c("suspicion_score") >= 2) & ~(sure & (c("suspicion_score") < 4)))
    return flagged if top is None else flagged.orderBy(F.desc("suspicion_score"), F.asc("deleted_at"), F.asc("event_id")).limit(top)


def reliability_scorecard(df: DataFrame) -> DataFrame:
    """Score 0..100 from clamped penalties, with a status.

    Columns: average_score, execution_rate, attempts, rate_limits, exhausted.
    """
    c = F.col

    def clamp(x, hi):
        return F.greatest(F.lit(0.0), F.least(F.lit(float(hi)), x))

    limit_rate = F.coalesce(F.try_divide(c("rate_limits"), c("attempts")), F.lit(0.0))
    raw = (
        F.lit(100.0) - clamp(90.0 - c("average_score"), 20) - clamp((1.0 - c("execution_rate")) * 20.0, 20)
        - F.least(F.lit(15.0), limit_rate * 100.0) - F.least(F.lit(10.0), c("exhausted") * 2.0)
    )
    score = clamp(raw, 100)
    return df.withColumn("score", F.round(score, 1)).withColumn(
        "status", F.when(score >= 85, "HEALTHY").when(score >= 70, "WATCH").otherwise("AT_RISK")
    )


# Default reliability gates (metric, direction, threshold).
RELIABILITY_GATES = (
    ("score", "min", 75.0), ("execution_rate", "min", 0.90), ("average_score", "min", 70.0),
    ("rate_limits", "max", 25.0), ("timeouts", "max", 15.0), ("exhausted", "max", 10.0),
)


def gate_rows(scorecard: DataFrame, keys: Sequence[str], gates=RELIABILITY_GATES) -> DataFrame:
    """One row per (key, gate) with PASS or FAIL."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("gate"), F.lit(direction).alias("direction"), F.col(m).cast("double").alias("actual"), F.lit(limit).alias("threshold"))
        for m, direction, limit in gates
    ])
    ok = F.when(F.col("direction") == "min", F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold"))
    return scorecard.select(*keys, F.inline(rows)).withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def issue_rows(gates: DataFrame, providers: DataFrame) -> DataFrame:
    """Open issues from failed gates and from providers with failures, timeouts or rate limits."""
    g = gates.filter(F.col("status") == "FAIL").select(
        F.concat(F.lit("GATE-"), F.upper(F.replace("gate", F.lit("-"), F.lit("_")))).alias("issue_id"),
        F.lit("Reliability Gate Failure").alias("category"), F.lit("high").alias("severity"),
        F.lit("reliability_gates").alias("step"), F.col("gate").alias("input_signature"),
    )
    bad = (F.col("failures") > 0) | (F.col("timeouts") > 0) | (F.col("rate_limits") > 0)
    hard = (F.col("timeouts") > 0) | (F.col("rate_limits") > 0)
    p = providers.filter(bad).select(
        F.concat(F.lit("LLM-"), F.upper("provider"), F.lit("-001")).alias("issue_id"),
        F.lit("Provider Reliability Failure").alias("category"), F.when(hard, "high").otherwise("medium").alias("severity"),
        F.lit("llm_activity").alias("step"), F.lit("provider_failure_signal").alias("input_signature"),
    )
    return g.unionByName(p)


def history_summary(history: DataFrame, as_of: Column, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Mean score per look-back window and the latest score's distance from it, in one pass."""
    latest = F.max_by("score", F.struct("ts", "run_id"))
    aggs = [latest.alias("latest")]
    for w in windows:
        inside = F.to_date("ts") >= F.date_sub(as_of, w)
        aggs += [F.count_if(inside).alias(f"runs_{w}"), F.avg(F.when(inside, F.col("score"))).alias(f"avg_{w}")]
    row = history.agg(*aggs)
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(f"{w}d").alias("window"), F.col(f"runs_{w}").alias("runs"),
            F.round(F.coalesce(F.col(f"avg_{w}"), F.lit(0.0)), 2).alias("average_score"), F.round("latest", 2).alias("latest_score"),
            F.round(F.coalesce(F.col("latest") - F.col(f"avg_{w}"), F.lit(0.0)), 2).alias("delta_latest_vs_avg"),
        ) for w in windows
    ])))


def issue_registry(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Roll the registry forward: first and last seen, occurrences, open in this run or not.

    ``previous``: issue_key, first_seen, last_seen, occurrence_count; ``current``: issue_key, seen_at.
    """
    cur = current.groupBy("issue_key").agg(
        F.min("seen_at").alias("_first"), F.max("seen_at").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    return previous.join(cur, "issue_key", "full_outer").select(
        "issue_key",
        F.least("first_seen", "_first").alias("first_seen"), F.greatest("last_seen", "_last").alias("last_seen"),
        (F.coalesce("occurrence_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("occurrence_count"),
        F.when(F.col("_n").isNotNull(), "open").otherwise("closed").alias("status"),
    )


def score_summary(df: DataFrame, category: str, score: str, passed: Column) -> DataFrame:
    """Per category: tests, mean score, pass rate and counts per score band."""
    s = F.col(score)
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("tests"), F.round(F.avg(s), 2).alias("average_score"),
        pct(F.count_if(passed), F.count(F.lit(1))).alias("success_rate_pct"),
        F.count_if(s >= 90).alias("excellent"), F.count_if((s >= 70) & (s < 90)).alias("good"),
        F.count_if((s >= 50) & (s < 70)).alias("fair"), F.count_if(s < 50).alias("poor"),
    )


def run_diff(before: DataFrame, after: DataFrame, link: str, stamp: str) -> DataFrame:
    """Rows and distinct links at start and end of a run, what was added, and the time between."""
    def side(df, tag):
        links = df.groupBy(link).agg(F.count(F.lit(1)).alias("n"), F.max(stamp).alias("t"))
        return links.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias(f"events_{tag}"), F.count(F.lit(1)).alias(f"urls_{tag}"), F.max("t").alias(f"time_{tag}")
        )

    return side(before, "start").join(F.broadcast(side(after, "end"))).select(
        "events_start", "events_end", "urls_start", "urls_end",
        (F.col("events_end") - F.col("events_start")).alias("new_events"), (F.col("urls_end") - F.col("urls_start")).alias("new_urls"),
        (F.unix_seconds(F.col("time_end").cast("timestamp")) - F.unix_seconds(F.col("time_start").cast("timestamp"))).alias("elapsed_sec"),
    )


def dedup_stats(clusters: DataFrame, cluster: str = "component", canonical: str = "is_canonical") -> DataFrame:
    per = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.count_if(canonical).alias("c"))
    return per.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"), F.sum("c").alias("canonical_rows"),
        F.sum(F.col("n") - F.col("c")).alias("duplicate_rows"),
    )


def review_summary(df: DataFrame, label: Column, truth: Column | None = None) -> DataFrame:
    """Completed, missing, unknown, true and false review labels; and agreement with a truth column."""
    t = F.lower(tx.text(label))
    yes, no = t.isin("1", "true", "yes", "y"), t.isin("0", "false", "no", "n")
    done = yes | no
    agree = F.lit(None).cast("boolean") if truth is None else F.when(done, yes == truth)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(done).alias("completed"), F.count_if(t == "").alias("missing"),
        F.count_if((t != "") & ~done).alias("unknown"), F.count_if(yes).alias("true_rows"), F.count_if(no).alias("false_rows"),
        pct(F.count_if(agree), F.count(agree)).alias("correct_pct"),
    )


def exact_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], bins: int = 1024) -> DataFrame:
    """(group, one column per share): interpolated percentiles of finite values by selection.

    Each pass counts the values of the open ranges in ``bins`` equal parts and opens only
    the parts that hold a wanted rank, narrowed to the smallest and largest value in them.
    These two never share a part, so a range shrinks in each pass whatever the values are,
    and ends as one value. No task sorts values or holds more than a range's parts.
    """
    c = F.col
    # a struct is never NULL, so the group of a NULL key joins like any other
    v = df.filter(c(value).isNotNull()).select(F.struct(c(group).alias("k")).alias("_g"), c(value).cast("double").alias("_v"))
    span = v.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (c("_n") - 1)).alias("rank")) for name, q in shares.items()]))
    ranks = written(span.select("_g", "_lo", "_hi", wanted.alias("w")).select("_g", "_lo", "_hi", "w.name", "w.rank"))
    open_ = ranks.select("_g", "_lo", "_hi", F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("_r")).distinct().withColumn("_before", F.lit(0).cast("long"))
    done = open_.filter("_lo = _hi").select("_g", "_r", c("_lo").alias("_v"))
    open_ = written(open_.filter("_lo < _hi"))
    while not open_.isEmpty():
        ranges = open_.select("_g", "_lo", "_hi").distinct()
        met = v.join(ranges, "_g").filter(c("_v").between(c("_lo"), c("_hi")))
        # halves, as the whole width may be beyond the largest number
        part = F.least(F.lit(bins - 1), F.floor((c("_v") / 2 - c("_lo") / 2) / (c("_hi") / 2 - c("_lo") / 2) * bins))
        parts = met.groupBy("_g", "_lo", "_hi", part.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        below = Window.partitionBy("_g", "_lo", "_hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_under", F.coalesce(F.sum("_c").over(below), F.lit(0)))
        hit = open_.join(parts, ["_g", "_lo", "_hi"]).filter((c("_r") >= c("_before") + c("_under")) & (c("_r") < c("_before") + c("_under") + c("_c")))
        hit = written(hit.select("_g", "_r", c("_low").alias("_lo"), c("_high").alias("_hi"), (c("_before") + c("_under")).alias("_before")))
        done = done.unionByName(hit.filter("_lo = _hi").select("_g", "_r", c("_lo").alias("_v")))
        open_ = written(hit.filter("_lo < _hi"))
    at = ranks.select("_g", "name", "rank", F.explode(F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))).alias("_r")).join(done, ["_g", "_r"])
    lo, hi = F.min_by("_v", "_r"), F.max_by("_v", "_r")
    pts = at.groupBy("_g", "name").agg((lo + (hi - lo) * (F.first("rank") - F.floor(F.first("rank")))).alias("p"))
    return pts.groupBy("_g").pivot("name", list(shares)).agg(F.first("p")).select(c("_g.k").alias(group), *shares)


def latency_summary(df: DataFrame, group: str, value: str, failed: Column, limit: float, exact: bool = True) -> DataFrame:
    """Attempts, failures, mean, median, p95, extremes and the share within ``limit`` per group.

    Percentiles are exact by selection, or approximate from one pass with constant state.
    """
    rows = df.select(group, F.when(~failed, F.col(value)).alias("_val"), failed.alias("_failed"))
    v = F.col("_val")
    sketch = [] if exact else [F.round(F.approx_percentile(v, q, 10000), 4).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95))]
    out = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("_failed").alias("failures"), F.round(F.avg(v), 4).alias("avg"), *sketch,
        F.min(v).alias("min"), F.max(v).alias("max"), pct(F.count_if(v <= limit), F.count(v)).alias("within_limit_pct"),
    )
    if not exact:
        return out
    p = exact_percentiles(rows, group, "_val", {"p50": 0.5, "p95": 0.95}).withColumnRenamed(group, "_pg")
    return out.join(p, out[group].eqNullSafe(p["_pg"]), "left").drop("_pg").withColumns({"p50": F.round("p50", 4), "p95": F.round("p95", 4)})


def block_triage(occ: DataFrame, keys: Sequence[str], url: str) -> DataFrame:
    """Unique URLs, attempts and a sample per blocking reason, counted in two levels."""
    per_url = occ.groupBy(*keys, url).agg(F.count(F.lit(1)).alias("n"))
    return per_url.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_urls"), F.sum("n").alias("attempts"), F.min(url).alias("sample_url")
    )


def kpi_scorecard(metrics: DataFrame, weights: dict[str, float], back_days: int = 30) -> DataFrame:
    """Weighted total of KPI scores per run and its mean over the trailing days before the run.

    ``metrics``: run (date), metric, value. Runs are few; the trailing mean is a range join on dates.
    """
    wide = metrics.groupBy("run").pivot("metric", list(weights)).agg(F.first("value"))
    total = F.lit(0.0)
    for m, w in weights.items():
        total = total + F.coalesce(F.col(m), F.lit(0.0)) * w
    scored = wide.withColumn("total_score", total)
    w = Window.orderBy(F.unix_date("run")).rangeBetween(-back_days, -1)
    return scored.withColumn("baseline", F.avg("total_score").over(w)).withColumn("delta", F.col("total_score") - F.col("baseline"))


def run_delta(observations: DataFrame, definitions: DataFrame) -> DataFrame:
    """Change of each metric against the previous run, with its direction of goodness.

    ``observations``: metric, run, value; ``definitions``: metric, higher_is_better.
    """
    w = Window.partitionBy("metric").orderBy("run")
    d = observations.withColumn("previous", F.lag("value").over(w)).withColumn("delta", F.col("value") - F.col("previous"))
    better = F.when(F.col("higher_is_better"), F.col("delta") > 0).otherwise(F.col("delta") < 0)
    return d.join(definitions, "metric").withColumn(
        "direction",
        F.when(F.col("previous").isNull(), "new").when(F.col("delta") == 0, "unchanged").when(better, "improved").otherwise("regressed"),
    )


def coverage_summary(watch: DataFrame, crawled: DataFrame, captured: DataFrame, key: str) -> DataFrame:
    """Share of the watch list that was crawled, that gave events, and of its priority part that was crawled."""
    hit = crawled.select(F.col(key).alias("_c")).distinct().withColumn("_hit", F.lit(True))
    cap = captured.select(F.col(key).alias("_p")).distinct().withColumn("_cap", F.lit(True))
    j = watch.join(hit, watch[key] == hit["_c"], "left").join(cap, watch[key] == cap["_p"], "left")
    h, c = F.coalesce("_hit", F.lit(False)), F.coalesce("_cap", F.lit(False))
    return j.agg(
        F.count(F.lit(1)).alias("watched"), pct(F.count_if(h), F.count(F.lit(1))).alias("hit_pct"),
        pct(F.count_if(c), F.count(F.lit(1))).alias("capture_pct"),
        pct(F.count_if(h & F.col("priority")), F.count_if("priority")).alias("priority_hit_pct"),
    )


def _clamp(c: Column, lo: int, hi: int) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def crawl_tuning(t: DataFrame, min_requests: int = 200, min_checks: int = 60) -> DataFrame:
    """Bounded changes of crawl settings from timeout and block ratios.

    Columns in: requests, timeouts, breaker_triggers, checks, blocks, strikes, and the
    settings timeout_sec, retries, concurrency, per_domain, wait_min_ms, wait_max_ms.
    """
    timeout_ratio = F.coalesce(F.try_divide(F.col("timeouts"), F.col("requests")), F.lit(0.0))
    block_ratio = F.coalesce(F.try_divide(F.col("blocks"), F.col("checks")), F.lit(0.0))
    enough = F.col("requests") >= min_requests
    slow = enough & (timeout_ratio >= 0.22)
    fast = enough & (timeout_ratio <= 0.08) & (F.col("breaker_triggers") == 0)
    calm = (F.col("checks") >= min_checks) & (F.col("strikes") == 0) & (block_ratio <= 0.02)
    tense = (block_ratio >= 0.08) | (F.col("strikes") > 0)

    def move(c, down_when, down, up_when, up):
        own = F.col(c)
        return F.when(down_when, _clamp(own + down[0], *down[1:])).when(up_when, _clamp(own + up[0], *up[1:])).otherwise(own)

    never = F.lit(False)
    return t.withColumns({
        "timeout_ratio": F.round(timeout_ratio, 4), "blocked_ratio": F.round(block_ratio, 4),
        "new_timeout_sec": move("timeout_sec", slow, (-10, 25, 70), never, (0, 25, 70)),
        "new_retries": move("retries", slow, (-1, 1, 3), never, (0, 1, 3)),
        "new_concurrency": move("concurrency", slow, (-2, 4, 16), fast, (2, 4, 20)),
        "new_per_domain": move("per_domain", slow, (-1, 1, 6), fast, (1, 1, 8)),
        "new_wait_min_ms": move("wait_min_ms", calm, (-1000, 2500, 20000), tense, (1000, 2500, 30000)),
        "new_wait_max_ms": move("wait_max_ms", calm, (-1500, 6000, 30000), tense, (1500, 6000, 45000)),
    })


def issue_trends(issues: DataFrame, as_of: Column, section: str, key: str, seen: str) -> DataFrame:
    """Per section: issues, most occurrences, greatest age and a score = occurrences + min(age, 30) / 4."""
    per = issues.groupBy(section, key).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first"))
    g = per.groupBy(section).agg(
        F.count(F.lit(1)).alias("issues"), F.max("n").alias("max_occurrences"), F.max(F.datediff(as_of, F.col("first"))).alias("max_age_days")
    )
    return g.withColumn("score", F.col("max_occurrences") + F.least(F.col("max_age_days"), F.lit(30)) * 0.25)


def failure_summary(failures: DataFrame, important: DataFrame) -> DataFrame:
    """Failures per type, stage and importance with their rate over all important URLs of that class."""
    base = important.groupBy("importance").agg(F.count(F.lit(1)).alias("total"))
    f = failures.groupBy("failure_type", "failure_stage", "importance").agg(F.count(F.lit(1)).alias("failures"))
    return f.join(base, "importance", "left").withColumn("failure_pct", pct(F.col("failures"), F.col("total")))


def integrity_counts(fact: DataFrame, dim: DataFrame, key: str, dim_key: str, name: str, full: str) -> DataFrame:
    """Key coverage of a fact table and naming consistency of its dimension, as one row."""
    f = fact.agg(
        F.count(F.lit(1)).alias("fact_rows"), F.count(key).alias("with_key"), F.min(key).alias("min_key"), F.max(key).alias("max_key")
    )
    broken = fact.filter(F.col(key).isNotNull()).join(dim, fact[key] == dim[dim_key], "left_anti").agg(F.count(F.lit(1)).alias("broken_refs"))
    d = dim.agg(F.count(F.lit(1)).alias("dim_rows"), F.count_if(~F.startswith(F.col(full), F.col(name))).alias("name_not_leading"))
    return f.join(F.broadcast(broken)).join(F.broadcast(d))


def guardrails(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Metric rows outside their limits. ``limits``: metric, direction (min|max), threshold."""
    j = metrics.join(limits, "metric")
    bad = F.when(F.col("direction") == "min", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return j.filter(bad)


def promotion_gate(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (per key): promote only when every check passes and at least one ran."""
    return checks.groupBy(*keys).agg(F.bool_and("passed").alias("promote"), F.count_if(~F.col("passed")).alias("failed_checks"))


def action_queue(parts: Sequence[DataFrame], title: str, limit: int = 12) -> DataFrame:
    """Concatenate priority classes, first title wins, at most ``limit`` items (the report's length)."""
    tagged = [p.withColumn("priority", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    best = union.groupBy(title).agg(F.min_by(F.struct("priority", "reason"), F.struct("priority", "reason")).alias("b"))
    return best.select(title, "b.priority", "b.reason").orderBy("priority", title).limit(limit)


def domain_cap(df: DataFrame, domain: str, order: Sequence[Column], k: int) -> DataFrame:
    return top_per_key(df, [domain], order, k)
