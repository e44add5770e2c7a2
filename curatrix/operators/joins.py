"""Joins of the crawl and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u
from .keyed import spread, top_per_key


def crawl_decisions(
    urls: DataFrame, log: DataFrame, history: DataFrame, blocked: DataFrame, whitelist: DataFrame, as_of: Column,
    old_days: int = 7, kinds=u.STATIC_DETAIL_KINDS, blocked_host: str | None = "facebook.com",
    low_value=u.LOW_VALUE_SEGMENTS, min_ratio: float = 0.5, max_early_tries: int = 2,
) -> DataFrame:
    """Crawl or skip each URL, with the first rule that applies as reason.

    ``urls``: link. ``log``: link, relevant, crawl_try, time_stamp, decision_reason.
    ``history``: url, start_date. ``blocked``: url seen as blocked in all recent runs.
    ``whitelist``: root. Each input is reduced to one row per key before it is joined,
    so every join is at most one row per URL wide.
    """
    latest = F.struct("time_stamp", "relevant")
    good, bad = F.count_if("relevant"), F.count_if(~F.col("relevant"))
    seen = log.groupBy(F.col("link").alias("_l")).agg(
        F.max_by("relevant", latest).alias("_last"), F.max_by("decision_reason", latest).alias("_last_reason"),
        F.when(good == 0, 0.0).when(bad == 0, 1.0).otherwise(F.try_divide(good, bad)).alias("_ratio"),
        F.sum("crawl_try").alias("_tries"),
    )
    hist = history.groupBy(F.col("url").alias("_hu")).agg(F.max("start_date").alias("_hd"))
    # spread by link: the URL rules below are CPU-heavy, and the joins use the same key
    base = spread(urls.select("link"), "link").distinct().withColumn("_n", u.strip_cdn_params("link")).withColumn("_k", u.detail_url_kind("_n", kinds))
    keys = base.select(
        F.col("link").alias("_bl"), F.col("_n").alias("_own"),
        F.explode(F.array_distinct(F.concat(F.array("_n"), F.col("_k.candidates")))).alias("_cand"),
    )
    dated = keys.join(hist, keys["_cand"] == hist["_hu"]).groupBy("_bl").agg(
        F.max("_hd").alias("_any_date"), F.max(F.when(F.col("_cand") == F.col("_own"), F.col("_hd"))).alias("_own_date")
    )
    stop = blocked.select(u.url_compare_key("url").alias("_bk")).distinct().withColumn("_stopped", F.lit(True))
    roots = whitelist.select(u.url_compare_key("root").alias("_r")).distinct()
    roots = roots.select(u.scheme("_r").alias("_rs"), u.netloc("_r").alias("_rh"), u.path("_r").alias("_rp"))
    cmp_keys = base.select(F.col("link").alias("_wl"), u.url_compare_key("_n").alias("_c"))
    listed = (
        cmp_keys.withColumns({"_s": u.scheme("_c"), "_h": u.netloc("_c"), "_p": u.path("_c")})
        .join(roots, (F.col("_s") == F.col("_rs")) & (F.col("_h") == F.col("_rh")) & F.startswith("_p", "_rp"), "left_semi")
        .select("_wl").withColumn("_white", F.lit(True))
    )
    j = base.withColumn("_ck", u.url_compare_key("_n"))
    j = j.join(seen, j["_n"] == seen["_l"], "left").join(dated, j["link"] == dated["_bl"], "left")
    j = j.join(stop, j["_ck"] == stop["_bk"], "left").join(listed, j["link"] == listed["_wl"], "left")
    kind = F.col("_k.kind")
    on_host = F.lit(True) if blocked_host is None else u.netloc("_n").contains(blocked_host)
    reason = (
        F.when(F.col("_white"), "process_whitelisted")
        .when(F.col("_l").isNull(), "process_never_seen")
        .when(F.col("_last_reason") == F.concat(F.lit("rejected_old_"), kind), F.concat(F.lit("skip_rejected_old_"), kind))
        .when(kind.isNotNull() & (F.col("_any_date") < as_of), F.concat(F.lit("skip_stale_"), kind))
        .when(on_host & F.col("_stopped"), "skip_stale_facebook_blocked_url")
        .when(F.col("_last") & F.coalesce(F.col("_own_date") < F.date_sub(as_of, old_days), F.lit(True)), "process_last_relevant_and_stale_date")
        .when(~F.col("_last") & u.low_value_path("_n", low_value), "skip_low_value_path_after_irrelevant")
        .when((F.col("_ratio") >= min_ratio) | (F.col("_tries") <= max_early_tries), "process_strong_hit_ratio_or_early_retry")
        .otherwise("skip_default_rules")
    )
    return j.select("link", reason.alias("decision_reason")).withColumn("process", F.startswith("decision_reason", F.lit("process_")))


def time_window_losers(df: DataFrame, keys: Sequence[str], secs: int = 900) -> DataFrame:
    """Ids of rows with a later twin: equal keys, start and end at most ``secs`` apart, higher event_id.

    Times are cut into cells of ``secs`` seconds. All rows of a cell lie within the
    window of each other, so every row but the cell's newest loses outright; only that
    one newest row per cell is compared with the eight cells around it. No pairs of
    rows are formed and the work stays linear however many rows share a key.
    """
    rows = df.dropna(subset=[*keys, "start_sec", "end_sec"]).select(
        *keys, "event_id", "start_sec", "end_sec",
        F.floor(F.col("start_sec") / secs).alias("_cs"), F.floor(F.col("end_sec") / secs).alias("_ce"),
    )
    cell = [*keys, "_cs", "_ce"]
    # three fixed-width aggregates keep this a hash aggregation (a struct would sort every map output)
    newest = rows.groupBy(*cell).agg(
        F.max("event_id").alias("_id"), F.max_by("start_sec", "event_id").alias("_s"), F.max_by("end_sec", "event_id").alias("_e"))
    inside = rows.join(newest.select(*cell, "_id"), cell).filter(F.col("event_id") < F.col("_id")).select("event_id")
    around = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)
    ])
    probes = newest.withColumn("_o", F.explode(around)).select(
        *keys, (F.col("_cs") + F.col("_o.a")).alias("_cs"), (F.col("_ce") + F.col("_o.b")).alias("_ce"), "_id", "_s", "_e"
    )
    near = probes.join(rows, cell).filter(
        (F.col("_id") < F.col("event_id"))
        & (F.abs(F.col("_s") - F.col("start_sec")) <= secs)
        & (F.abs(F.col("_e") - F.col("end_sec")) <= secs)
    ).select(F.col("_id").alias("event_id")).distinct()
    return inside.unionByName(near)


def drop_time_window_duplicates(df: DataFrame, keys: Sequence[str], secs: int = 900) -> DataFrame:
    return df.join(time_window_losers(df, keys, secs), "event_id", "left_anti")


def venue_conflict_rows(df: DataFrame, slot: Sequence[str], name: str) -> DataFrame:
    """Rows that share a slot with another name: slot size, number of other-name rows and the first of them.

    Linear: counts per (slot, name) and per slot, no pairs.
    """
    per_name = df.dropna(subset=[*slot, name]).groupBy(*slot, name).agg(F.count(F.lit(1)).alias("_n"), F.min("event_id").alias("_first"))
    per_slot = per_name.groupBy(*slot).agg(
        F.sum("_n").alias("_slot_n"), F.count(F.lit(1)).alias("_names"), F.min_by(F.struct("_first", name), "_first").alias("_a"),
    ).filter(F.col("_names") > 1)
    second = per_name.join(per_slot.select(*slot, "_a"), list(slot)).filter(F.col(name) != F.col(f"_a.{name}")).groupBy(*slot).agg(
        F.min("_first").alias("_b")
    )
    marks = per_name.join(per_slot, list(slot)).join(second, list(slot)).select(
        *slot, name, (F.col("_slot_n") - F.col("_n")).alias("conflicts"),
        F.when(F.col(name) == F.col(f"_a.{name}"), F.col("_b")).otherwise(F.col("_a._first")).alias("first_conflict_id"),
    )
    return df.join(marks, [*slot, name])


def venue_conflict_pairs(df: DataFrame, slot: Sequence[str], name: str, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs (event_id_1 < event_id_2) in one slot under different names.

    Copies of one name never meet: names are paired first, rows are attached to the
    name pairs, so only rows of the result are produced.
    """
    rows = df.dropna(subset=[*slot, name])
    names = rows.select(*slot, name).distinct()
    pairs = names.withColumnRenamed(name, "_na").join(names.withColumnRenamed(name, "_nb"), list(slot)).filter(F.col("_na") < F.col("_nb"))
    a = rows.select(*slot, F.col(name).alias("_na"), F.struct("event_id", name, *carry).alias("_a"))
    b = rows.select(*slot, F.col(name).alias("_nb"), F.struct("event_id", name, *carry).alias("_b"))
    met = pairs.join(a, [*slot, "_na"]).join(b, [*slot, "_nb"])
    first = F.when(F.col("_a.event_id") < F.col("_b.event_id"), F.col("_a")).otherwise(F.col("_b"))
    last = F.when(F.col("_a.event_id") < F.col("_b.event_id"), F.col("_b")).otherwise(F.col("_a"))
    out = met.select(*slot, first.alias("_x"), last.alias("_y"))
    return out.select(
        *slot, F.col("_x.event_id").alias("event_id_1"), F.col("_y.event_id").alias("event_id_2"),
        *[F.col(f"_x.{c}").alias(f"{c}_1") for c in (name, *carry)], *[F.col(f"_y.{c}").alias(f"{c}_2") for c in (name, *carry)],
    )


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is set but missing in the parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def clear_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Set dangling keys to 0."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct()
    joined = child.join(p, child[key] == p["_p"], "left")
    return joined.withColumn(key, F.when((F.col(key) > 0) & F.col("_p").isNull(), F.lit(0)).otherwise(F.col(key))).drop("_p")


def sync_from_dim(fact: DataFrame, dim: DataFrame, key: str, dim_key: str, column: str, dim_column: str) -> DataFrame:
    """Overwrite a fact text with the dimension's text where the key is known."""
    d = dim.select(F.col(dim_key).alias("_d"), F.col(dim_column).alias("_v"))
    return fact.join(d, fact[key] == d["_d"], "left").withColumn(column, F.coalesce("_v", column)).drop("_d", "_v")


def apply_labels(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Adds ``decision``: delete for label 1, keep for 0 or no label, invalid otherwise.

    Different labels for one id are invalid; the smallest is shown.
    """
    raw = labels.groupBy(F.col(key).alias("_k")).agg(F.min(label).alias(label), (F.min(label) != F.max(label)).alias("_several"))
    joined = df.join(raw, df[key] == raw["_k"], "left")
    value = tx.binary_label(label, "strict")
    decision = F.when(F.col(label).isNull(), "keep").when(value == 1, "delete").when(value == 0, "keep").otherwise("invalid")
    return joined.withColumn("decision", F.when(F.col("_several"), "invalid").otherwise(decision)).drop("_k", "_several")


def fill_missing(df: DataFrame, rules: DataFrame, key: str, text_column: str) -> DataFrame:
    """NULL foreign keys from an override table on the lower-cased text; first rule (lowest order) wins.

    ``rules``: rule_order, match_text, key_value, full_text.
    """
    r = rules.filter(~tx.blank("full_text")).groupBy(F.lower(tx.text("match_text")).alias("_m")).agg(
        F.min_by(F.struct("key_value", "match_text", "full_text"), "rule_order").alias("_r")
    )
    leads = F.startswith(F.lower(F.col("_r.full_text")), F.lower(tx.text("_r.match_text")))
    full = F.when(tx.blank("_r.match_text") | leads, F.col("_r.full_text")).otherwise(
        F.concat_ws(", ", tx.text("_r.match_text"), F.col("_r.full_text")))
    missing = df.withColumn("_q", F.when(F.col(key).isNull(), F.lower(tx.text(text_column))))
    hit = F.col("_m").isNotNull()
    return missing.join(r, missing["_q"] == r["_m"], "left").withColumns({
        key: F.coalesce(key, F.col("_r.key_value")), text_column: F.when(hit, full).otherwise(F.col(text_column)), "filled": hit,
    }).drop("_q", "_m", "_r")


def history_reuse(urls: DataFrame, history: DataFrame, as_of: Column, window_days: int = 7, kinds=u.STATIC_DETAIL_KINDS) -> DataFrame:
    """Reuse the one upcoming event a detail URL had before, instead of crawling it again.

    Adds reused and reason; event columns come from the newest matching history row.
    Identities are counted as distinct hashes by min <> max, so state per URL is constant.
    """
    base = urls.withColumn("_k", u.detail_url_kind("link", kinds))
    keys = base.filter(F.col("_k.kind").isNotNull()).select(F.col("link").alias("_l"), F.explode("_k.candidates").alias("_c"))
    ident = F.sha2(F.concat_ws(
        "\u0001", tx.text("url"), F.lower(tx.text("event_name")), F.col("start_date").cast("string"), tx.text("start_sec"),
        F.coalesce(F.col("end_date").cast("string"), F.lit("")), tx.text("end_sec")), 256)
    h = history.withColumns({"_id": ident, "_up": F.coalesce(F.col("start_date") > F.date_add(as_of, window_days), F.lit(False))})
    cols = history.columns
    g = keys.join(h, keys["_c"] == h["url"]).groupBy("_l").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("_up").alias("_n_up"),
        F.min(F.when(F.col("_up"), F.col("_id"))).alias("_lo"), F.max(F.when(F.col("_up"), F.col("_id"))).alias("_hi"),
        F.max_by(F.when(F.col("_up"), F.struct(*cols)), F.when(F.col("_up"), F.struct("time_stamp", "event_id"))).alias("_row"),
    )
    j = base.join(g, base["link"] == g["_l"], "left")
    reason = (
        F.when(F.col("_k.kind").isNull(), "not_static_event_detail")
        .when(F.col("_rows").isNull(), "no_history_rows")
        .when(F.col("_n_up") == 0, "no_upcoming_history_outside_rescrape_window")
        .when(F.col("_lo") != F.col("_hi"), "ambiguous_history_match")
        .otherwise("history_reuse_static_event_detail")
    )
    out = j.withColumn("reason", reason).withColumn("reused", F.col("reason") == "history_reuse_static_event_detail")
    return out.select("link", "reused", "reason", F.when(F.col("reused"), F.col("_row")).alias("event"))


def routing_memory(
    metrics: DataFrame, replay: DataFrame, min_samples: int = 3, dominance: float = 0.8, min_success: float = 0.7, max_runs: int = 24
) -> DataFrame:
    """The routing a URL has proven: its dominant (archetype, owner, subtype) over its newest replayed runs.

    ``metrics``: run_id, link, archetype, owner_step, subtype, stage, confidence, time_stamp.
    ``replay``: run_id, url, is_match.
    """
    latest = metrics.groupBy("run_id", "link").agg(
        F.max_by(F.struct("archetype", "owner_step", "subtype", "stage", "confidence", "time_stamp"), "time_stamp").alias("m")
    ).select("run_id", "link", "m.*")
    ok = replay.groupBy(F.col("run_id").alias("_r"), F.col("url").alias("_u")).agg(F.bool_and("is_match").alias("success"))
    seen = latest.join(ok, (F.col("run_id") == F.col("_r")) & (F.col("link") == F.col("_u")))
    recent = top_per_key(seen, ["link"], [F.desc("time_stamp"), F.desc("run_id")], max_runs).filter(
        ~tx.blank("archetype") & ~tx.blank("owner_step")
    )
    per_stage = recent.groupBy("link", "archetype", "owner_step", "subtype", F.coalesce(tx.filled("stage"), F.lit("unknown")).alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"), F.sum("confidence").alias("cs"), F.count("confidence").alias("cn")
    )
    combo = per_stage.groupBy("link", "archetype", "owner_step", "subtype").agg(
        F.sum("n").alias("sample_count"), F.sum("ok").alias("success_count"), F.sum("cs").alias("cs"), F.sum("cn").alias("cn"),
        F.min_by("stage", F.struct(-F.col("n"), F.col("stage"))).alias("stage_mode"),
    )
    top = combo.groupBy("link").agg(
        F.sum("sample_count").alias("total"),
        F.max_by(F.struct("archetype", "owner_step", "subtype", "sample_count", "success_count", "cs", "cn", "stage_mode"),
                 F.struct("sample_count", "archetype")).alias("t"),
    ).select("link", "total", "t.*")
    share, rate = F.col("sample_count") / F.col("total"), F.col("success_count") / F.col("sample_count")
    return top.filter(
        (F.col("sample_count") >= min_samples) & (share >= dominance) & (F.col("success_count") >= min_samples) & (rate >= min_success)
    ).select(
        "link", "archetype", "owner_step", "subtype", "sample_count", "success_count", F.round(rate, 4).alias("success_rate"),
        F.round(share, 4).alias("dominance"), F.round(F.try_divide("cs", "cn"), 4).alias("avg_confidence"), "stage_mode",
    )


def audit_capture(expected: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which expected rows exist in the table (by URL, name and date keys)."""
    have = events.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_found", F.lit(True))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (expected[k] == have[f"_{k}"])
    return expected.join(have, cond, "left").withColumn("captured", F.coalesce("_found", F.lit(False))).drop("_found", *[f"_{k}" for k in keys])


def url_failures(important: DataFrame, log: DataFrame, as_of: Column, windows: dict[str, int], thresholds: dict[str, int],
                 default_window: int = 3, default_threshold: int = 2, newest: int = 5) -> DataFrame:
    """Important URLs that were not attempted, found irrelevant repeatedly, or retried in vain.

    ``important``: url, source, importance. ``log``: link, parent_url, relevant, crawl_try,
    keywords, time_stamp. Only the five newest attempts in the window count; child pages
    that succeeded suppress the first two kinds.
    """
    days, limit = F.lit(default_window), F.lit(default_threshold)
    for kind, v in windows.items():
        days = F.when(F.col("importance") == kind, v).otherwise(days)
    for kind, v in thresholds.items():
        limit = F.when(F.col("importance") == kind, v).otherwise(limit)
    base = important.withColumns({"_from": (as_of - F.make_dt_interval(days)).cast("timestamp_ntz"), "_limit": limit})
    keys = base.select(F.col("url").alias("_u"), "importance", "_from", F.explode(u.url_variants("url")).alias("_v"))
    hits = keys.join(log, keys["_v"] == log["link"]).select(
        "_u", "importance", "_from", "relevant", "crawl_try", "keywords", "time_stamp", (F.col("time_stamp") >= F.col("_from")).alias("_in")
    )
    overall = hits.groupBy("_u", "importance").agg(F.max("time_stamp").alias("_ever"))
    five = top_per_key(hits.filter("_in"), ["_u", "importance"], [F.desc("time_stamp"), F.desc("crawl_try")], newest)
    recent = five.groupBy("_u", "importance").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("relevant").alias("_ok"),
        F.coalesce(F.min(F.when(F.col("relevant"), F.col("rn"))) - 1, F.count(F.lit(1))).alias("_streak"),
        F.min_by("crawl_try", "rn").alias("_tries"), F.min_by("keywords", "rn").alias("_kw"), F.max("time_stamp").alias("_last"),
    )
    child = keys.join(log.filter("relevant").select("parent_url", "time_stamp"), F.col("_v") == F.col("parent_url")).filter(
        F.col("time_stamp") >= F.col("_from")).groupBy("_u", "importance").agg(F.count(F.lit(1)).alias("_children"))
    j = base
    for part in (recent, child, overall):
        p = part.withColumnsRenamed({"_u": "_pu", "importance": "_pi"})
        j = j.join(p, (j["url"] == p["_pu"]) & (j["importance"] == p["_pi"]), "left").drop("_pu", "_pi")
    kids = F.coalesce("_children", F.lit(0)) > 0
    kind = (
        F.when(F.col("_rows").isNull(), F.when(~kids, "not_attempted"))
        .when((F.col("_ok") == 0) & (F.col("_streak") >= F.col("_limit")), F.when(~kids, "marked_irrelevant"))
        .when((F.col("_ok") == 0) & (F.col("_tries") >= 3), "multiple_retries")
    )
    return j.withColumn("failure_type", kind).filter(F.col("failure_type").isNotNull()).select(
        "url", "source", "importance", "failure_type",
        F.when(F.col("failure_type") == "not_attempted", "not_attempted_unattributed")
        .when(F.col("failure_type") == "marked_irrelevant", "attempted_no_keywords")
        .otherwise("attempted_extraction_or_llm_failure").alias("failure_stage"),
        F.when(F.col("failure_type") == "not_attempted",
               F.when(F.col("_ever").isNotNull(), "not_seen_in_window_historical_exists").otherwise("no_recent_url_rows"))
        .when(F.col("failure_type") == "marked_irrelevant", "recent_irrelevant_threshold_reached")
        .otherwise("retry_threshold_with_no_success").alias("reason_code"),
        F.coalesce("_rows", F.lit(0)).alias("recent_rows"), F.coalesce("_streak", F.lit(0)).alias("consecutive_irrelevant"),
        F.coalesce("_tries", F.lit(0)).alias("crawl_attempts"),
    )


def attempt_reasons(failures: DataFrame, lines: DataFrame) -> DataFrame:
    """Why not-attempted URLs were skipped, from log lines that name them.

    The URL is taken out of each line and joined by key; no line is scanned per URL.
    ``lines``: line.
    """
    low = F.lower("line")
    named = F.regexp_extract(low, r"(https?://[^\s,;\"')]+)", 1)
    limit = low.contains("url run limit reached")
    facts = lines.withColumns({"_url": named, "_limit": limit, "_skip": low.contains("should_process_url") & low.contains("skip")})
    per_url = facts.filter("_url <> '' and (_limit or _skip)").groupBy("_url").agg(F.bool_or("_limit").alias("_l"), F.bool_or("_skip").alias("_s"))
    any_limit = facts.agg(F.coalesce(F.bool_or("_limit"), F.lit(False)).alias("_any"))
    missing = failures.filter(F.col("failure_type") == "not_attempted").select("url").distinct()
    keys = missing.select(F.col("url").alias("_fu"), F.explode(F.transform(u.url_variants("url"), F.lower)).alias("_v")).distinct()
    hit = keys.join(per_url, keys["_v"] == per_url["_url"]).groupBy("_fu").agg(F.bool_or("_l").alias("_l"), F.bool_or("_s").alias("_s"))
    return missing.join(hit, missing["url"] == hit["_fu"], "left").join(F.broadcast(any_limit)).select(
        "url",
        F.when(F.col("_l"), "explicit_url_run_limit_skip").when(F.col("_s"), "explicit_should_process_url_skip")
        .when(F.col("_any"), "unattributed_with_global_run_limit").otherwise("other_or_unknown").alias("category"),
    )
