"""The write path: candidate rows to accepted events, with a reason for every rejected row."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import fuzzy as fz
from ..functions import text as tx
from ..functions import urls as u
from . import address as ad
from . import calendar as cal
from . import gates
from . import maintain
from . import normalize as norm
from . import rules as rl
from .entity import fuzzy_dedup
from .joins import fill_missing, orphans, sync_from_dim, time_window_losers
from .keyed import spread, top_per_key
from ..session import cut_lineage

# Dance styles the write path knows.
DANCE_STYLES = (
    "argentine tango", "tango", "salsa", "bachata", "kizomba", "semba", "urban kiz", "tarraxo", "tarraxa", "tarraxinha", "merengue",
    "rumba", "swing", "west coast swing", "wcs", "east coast swing", "lindy", "lindy hop", "balboa",
)


@dataclass
class WriteRules:
    """Settings of one write run."""

    as_of: Column
    old_days: int = 7
    blocked_hosts: Iterable[str] = ("example.com",)
    styles: Iterable[str] = DANCE_STYLES
    nonlocal_markers: Iterable[str] = gates.NONLOCAL_MARKERS
    local_markers: Iterable[str] = gates.LOCAL_MARKERS
    evidence_type: str = "live music"
    scores: Callable = fz.name_scores
    ratio: Callable = fz.indel_ratio
    overrides: DataFrame | None = None
    aliases: DataFrame | None = None
    cache: DataFrame | None = None
    required: Iterable[str] = field(default_factory=lambda: ("start_date", "end_date", "start_sec", "end_sec", "location", "description"))


def prepare(df: DataFrame, rules: WriteRules) -> DataFrame:
    """Row repairs before any lookup: styles, source, URL, overrides, dates, weekday, evidence.

    ``df``: row_id, event text columns, and batch_url, batch_parent, batch_source, batch_keywords.
    """
    words = F.filter(F.split(F.lower(tx.text("batch_keywords")), ","), lambda t: F.trim(t) != "")
    styled = df.withColumn("dance_style", F.when(tx.blank("dance_style"), tx.specific_terms(words, rules.styles)).otherwise(F.col("dance_style")))
    batch = u.resolve_source("batch_source", "batch_url", "batch_parent")
    sourced = styled.withColumn("batch_source", batch).withColumn(
        "source", F.when(tx.is_placeholder_source("source"), F.col("batch_source")).otherwise(tx.text("source")))
    linked = sourced.withColumn("url", F.when(tx.blank("url"), tx.text("batch_url")).otherwise(tx.text("url")))
    linked = gates.enforce_event_url(linked, "batch_url", "batch_parent", "batch_source", rules.blocked_hosts)
    if rules.overrides is not None:
        linked = rl.apply_overrides(linked, rules.overrides, ["event_type", "location", "dance_style"], "batch_url")
    start, end = dt.parse_event_ts("start_ts"), dt.parse_event_ts("end_ts")
    dated = linked.withColumns({"_s": start, "_e": end}).withColumns({
        "start_date": F.to_date("_s"), "end_date": F.to_date("_e"),
        "start_sec": F.when(F.col("start_ts").contains(":"), dt.day_seconds("_s")), "end_sec": F.when(F.col("end_ts").contains(":"), dt.day_seconds("_e")),
    }).drop("_s", "_e")
    rolled = cal.roll_overnight(dated).withColumn("day_of_week", dt.clean_weekday("day_of_week"))
    aligned = cal.align_recurring(rolled)
    live = F.lower(tx.text("event_type")).contains(rules.evidence_type)
    return norm.evidence_tags(aligned, rules.styles, live, ["event_name", "description"], "dance_style")


def _quality(rules: WriteRules, social: bool) -> Column:
    ctx = F.concat_ws(" ", "batch_source", "batch_url", "batch_parent")
    on_social = tx.squeeze(ctx).rlike("instagram_keyword_search|instagram\\.com") if social else F.lit(False)
    minimum = gates.has_minimum_data("event_name", "start_date", ("location", "description", "start_sec", "end_sec"))
    return gates.quality_reason(
        ("event_name", "location", "description", "source", "url"), ctx, on_social, minimum, rules.nonlocal_markers, rules.local_markers)


def write_events(df: DataFrame, addr: DataFrame, rules: WriteRules) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, new_addresses, url_log).

    Cheap gates run before the address lookup, so only rows that may be written reach its
    joins. Rows are rejected with the reason of the first gate they fail. The repaired
    rows feed the rejects, the lookups and the log, so they are written once.
    """
    # the rows are few bytes and much work, so they are spread over all cores
    ready = cut_lineage(spread(prepare(df, rules), "row_id"))
    pre = (
        F.when(~F.col("keep"), "missing_or_blocked_url")
        .when(gates.is_us_address("location"), "us_postal_code_location")
        .otherwise(F.coalesce(_quality(rules, False), F.when(gates.is_old(rules.as_of, rules.old_days, "drop"), "older_than_limit")))
    )
    gated = cut_lineage(ready.withColumn("reject_reason", pre).drop("keep"))
    passed = gated.filter(F.col("reject_reason").isNull())
    located, inserts = locate(passed, addr, rules)
    post = (
        F.when(gates.is_us_address("location"), "us_postal_code_location")
        .otherwise(F.coalesce(_quality(rules, True), F.when(gates.all_empty(rules.required), "all_fields_empty")))
    )
    checked = cut_lineage(spread(located, "row_id").withColumn("reject_reason", post))
    accepted = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = gated.filter(F.col("reject_reason").isNotNull()).select("row_id", "batch_url", "reject_reason").unionByName(
        checked.filter(F.col("reject_reason").isNotNull()).select("row_id", "batch_url", "reject_reason"))
    return accepted, rejected, inserts, url_log(accepted, rejected)


def locate(df: DataFrame, addr: DataFrame, rules: WriteRules) -> tuple[DataFrame, DataFrame]:
    """(rows with address_id and location, new addresses) by street, alias, cache, quick lookup, name in text, parsed address."""
    hits = ad.match_street(df, addr, "row_id", "location").withColumn("step", F.lit(1))
    if rules.aliases is not None:
        hits = hits.unionByName(rl.alias_match(df, rules.aliases, "row_id", ["location"]).filter("decision = 'applied'").select("row_id", "address_id", F.lit(2).alias("step")))
    if rules.cache is not None:
        hits = hits.unionByName(ad.cache_lookup(df, rules.cache, addr, "row_id", "location").withColumn("step", F.lit(3)))
    first = lambda hits: cut_lineage(hits.groupBy("row_id").agg(F.min_by("address_id", F.struct("step", "address_id")).alias("address_id")))
    found = first(hits)
    # the scored look-ups see only rows that the steps by key leave over; written once, because each is read again
    rest = cut_lineage(df.drop("address_id").join(found, "row_id", "left_anti"))
    if not rest.isEmpty():
        quick = cut_lineage(ad.quick_lookup(rest, addr, "row_id", "location", rules.scores, rules.ratio).select("row_id", "address_id"))
        found = found.unionByName(quick)
        rest = cut_lineage(rest.join(quick, "row_id", "left_anti"))
    body = rest.withColumn("_body", F.concat_ws(" ", tx.text("event_name"), tx.text("description")))
    named = ad.name_in_text(body, addr, "row_id", "_body", rules.ratio if rules.ratio is not fz.indel_ratio else fz.partial_ratio).select("row_id", "address_id")
    parsed = rest.join(named, "row_id", "left_anti").filter(~tx.blank("location")).withColumn("_p", norm.split_full_address("location")).select(
        "row_id", F.when(F.col("_p.street_number").isNull(), F.trim(F.substring_index("location", ",", 1))).otherwise(
            F.nullif(F.trim(F.regexp_extract("location", r"^([^,\d]+),", 1)), F.lit(""))).alias("building_name"), "_p.*")
    parsed = cut_lineage(parsed)
    matched, inserts = ad.resolve_address(parsed, addr, "row_id", rules.scores)
    new_ids = parsed.withColumn("full_address", norm.build_full_address(parsed)).join(inserts.select("full_address", "address_id"), "full_address").select("row_id", "address_id")
    known = found.unionByName(named).unionByName(matched.select("row_id", "address_id")).unionByName(new_ids.join(matched, "row_id", "left_anti").select("row_id", "address_id"))
    one = known.groupBy("row_id").agg(F.min("address_id").alias("address_id"))
    located = df.drop("address_id").join(one, "row_id", "left")
    if "full_address" in addr.columns:
        located = sync_from_dim(located, addr, "address_id", "address_id", "location", "full_address")
    return located, inserts


def url_log(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """One crawl-log row per batch URL: relevant when a row was accepted, else with its most frequent reason."""
    ok = accepted.groupBy(F.col("batch_url").alias("link")).agg(F.count(F.lit(1)).alias("events_written"))
    counts = rejected.groupBy(F.col("batch_url").alias("link"), "reject_reason").agg(F.count(F.lit(1)).alias("n"))
    why = top_per_key(counts, ["link"], [F.desc("n"), F.asc("reject_reason")], 1).select("link", F.col("reject_reason").alias("_why"))
    j = ok.join(why, "link", "full_outer")
    relevant = F.col("events_written").isNotNull()
    return j.select("link", relevant.alias("relevant"), F.coalesce("events_written", F.lit(0)).alias("events_written"), F.when(~relevant, F.col("_why")).alias("decision_reason"))


@dataclass
class CleanupRules:
    """Settings of one nightly cleanup."""

    as_of: Column
    deleted_at: Column
    old_days: int = 7
    countries: Iterable[str] = ()
    blocked_cities: Iterable[str] = ()
    known_bad: Column | None = None
    province: str = "BC"
    country: str = "CA"
    fuzzy_threshold: float = 80
    score: Callable = fz.indel_ratio
    window_sec: int = 900


def nightly_cleanup(events: DataFrame, addr: DataFrame, rules: CleanupRules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, addresses, audit) after the table clean-up, in its fixed order.

    The row rules (old, timeless, dud) are one reason column in one pass. Lineage is cut
    where a step needs several passes over its input.
    """
    fixed = cal.repair_weekday(events).select("event_id", F.col("day_of_week").alias("_dow"))
    ev = events.join(fixed, "event_id", "left").withColumn("day_of_week", F.coalesce("_dow", "day_of_week")).drop("_dow")
    effective_old = F.coalesce(F.col("end_date") < F.date_sub(rules.as_of, rules.old_days), F.lit(False))
    flagged = gates.dud_reason(ev, addr, rules.province, rules.country)
    reason = (
        F.when(effective_old, f"end_date_older_than_{rules.old_days}_days")
        .when(gates.null_times(), "null_start_date_start_time_or_null_start_end_time").otherwise(F.col("reason"))
    )
    flagged = cut_lineage(flagged.withColumn("reason", reason))
    audit = [_audit(flagged.filter(F.col("reason").isNotNull()), "db.row_rules", F.col("reason"), rules, events.columns)]
    ev = flagged.filter(F.col("reason").isNull()).drop("reason")

    survivors, merged = fuzzy_dedup(ev, ["start_date", "start_sec"], threshold=rules.fuzzy_threshold, score=rules.score)
    lost = merged.filter(~F.col("is_canonical")).select("event_id")
    audit.append(_audit(ev.join(lost, "event_id", "left_semi"), "db.fuzzy_duplicates", F.lit("fuzzy_duplicate_merged"), rules, events.columns))
    ev = cut_lineage(ev.join(merged.select("event_id"), "event_id", "left_anti").unionByName(survivors.select(*ev.columns)))

    foreign = gates.is_foreign(("location", "description", "source"), rules.countries, rules.blocked_cities)
    bad = F.lit(False) if rules.known_bad is None else F.coalesce(rules.known_bad, F.lit(False))
    why = F.when(foreign, "foreign_location").when(bad, "known_incorrect_rules")
    audit.append(_audit(ev.withColumn("_w", why).filter(F.col("_w").isNotNull()), "db.is_foreign", F.col("_w"), rules, events.columns))
    ev = ev.filter(why.isNull())

    clean_addr = norm.normalize_nulls(addr, [c for c, t in addr.dtypes if t == "string"])
    clean_addr = clean_addr.withColumn("full_address", norm.build_full_address(clean_addr))
    ev = sync_from_dim(ev, clean_addr, "address_id", "address_id", "location", "full_address")

    ev = cut_lineage(ev)
    twins = time_window_losers(ev, ["address_id", "start_date", "end_date"], rules.window_sec).distinct()
    audit.append(_audit(ev.join(twins, "event_id", "left_semi"), "db.dedup", F.lit("exact_time_window_duplicate"), rules, events.columns))
    ev = ev.join(twins, "event_id", "left_anti")
    dangling = orphans(ev, clean_addr, "address_id", "address_id").select("event_id")
    audit.append(_audit(ev.join(dangling, "event_id", "left_semi"), "db.clean_orphaned_references", F.lit("orphaned_address_id_reference"), rules, events.columns))
    ev = ev.join(dangling, "event_id", "left_anti")
    out = audit[0]
    for a in audit[1:]:
        out = out.unionByName(a)
    return ev.select(*events.columns), clean_addr, out


def _audit(rows: DataFrame, source: str, reason: Column, rules: CleanupRules, columns) -> DataFrame:
    return rows.select(
        "event_id", rules.deleted_at.alias("deleted_at"), F.lit(source).alias("deletion_source"), reason.alias("deletion_reason"),
        F.to_json(F.struct(*columns)).alias("event_json"),
    )


def rule_cleanup(events: DataFrame, keywords: DataFrame, overrides: DataFrame, closed: Column, known_bad: Column, as_of: Column, deleted_at: Column):
    """(events, audit) after the rule clean-up: closed venues, style tags, region, far future, missing keys, known bad rows."""
    kept, audit = maintain.audited_delete(events, closed, "clean_up.closed_venues", "closed_venue", deleted_at)
    tagged = rl.tag_by_keywords(kept, keywords, ["event_name", "description", "source"], "dance_style").drop("changed")
    out_of_area = F.when(gates.outside_region("location"), "outside_bc").when(gates.too_far_future(as_of), "too_far_future")
    marked = tagged.withColumn("_w", out_of_area)
    gone = marked.filter(F.col("_w").isNotNull())
    audit2 = gone.select(
        "event_id", deleted_at.alias("deleted_at"), F.lit("clean_up.region").alias("deletion_source"), F.col("_w").alias("deletion_reason"),
        F.lit("{}").alias("extra_context"), F.to_json(F.struct(*events.columns)).alias("event_json"))
    filled = fill_missing(marked.filter(F.col("_w").isNull()).drop("_w"), overrides, "address_id", "location").drop("filled")
    kept2, audit3 = maintain.audited_delete(filled.select(*events.columns), known_bad, "clean_up.known_incorrect", "known_incorrect_rules", deleted_at)
    return kept2, audit.unionByName(audit2).unionByName(audit3)
