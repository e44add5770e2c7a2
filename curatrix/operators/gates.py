"""Row filters. Each gate computes a reason column in one pass; kept and rejected are two filters on it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u
from .keyed import top_per_key

# Names that say nothing about the event.
EMPTY_NAMES = (
    "", "event", "events", "dance", "dance event", "no events", "no events found", "unknown", "unknown event", "n/a", "none",
)
# Words that place an event inside the served region.
LOCAL_MARKERS = (
    "victoria", "british columbia", " v8", "v8w", "v8v", "v8t", "v8x", "v8y", "v9a", "v9b", "v9c", "v9e", "v9z",
    "saanich", "esquimalt", "sidney", "langford", "colwood", "oak bay", "view royal", "vancouver island",
    "method studio", "the loft", "loft pub", "coda", "wicket hall", "anmore", "belcarra", "bowen island", "burnaby",
    "coquitlam", "delta", "langley", "lions bay", "maple ridge", "new westminster", "north vancouver", "pitt meadows",
    "port coquitlam", "port moody", "richmond", "surrey", "vancouver", "west vancouver", "white rock",
    "university of british columbia", "university endowment lands", "tsawwassen first nation", "tsawwassen",
)
# Words that place an event abroad.
NONLOCAL_MARKERS = ("poland", "warsaw", "krakow", "gdansk", "portugal", "lisbon", "porto", "europe")
# US states and territories.
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME",
    "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR", "VI", "GU", "AS", "MP",
)
# Words that hint at an event listing.
EVENT_SIGNALS = (
    "event", "events", "calendar", "schedule", "social", "dance", "workshop", "class", "lesson", "friday", "saturday",
    "sunday", "monday", "tuesday", "wednesday", "thursday",
)


def split_by_reason(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def has_value(c: Column | str) -> Column:
    return ~tx.squeeze(c).isin("", "nan", "nat", "none", "null", "<na>")


def has_minimum_data(name="event_name", start="start_date", details=("location", "description", "start_time", "end_time")) -> Column:
    any_detail = F.lit(False)
    for c in details:
        any_detail = any_detail | has_value(c)
    return ~tx.squeeze(name).isin(*EMPTY_NAMES) & has_value(start) & any_detail


def is_nonlocal(t: Column, markers: Iterable[str] = NONLOCAL_MARKERS) -> Column:
    def marked(padded):
        coded = padded.rlike(r"\b(?:pl|pt)\b") & padded.rlike(r"\b(?:country|conference|festival)\b")
        return coded | tx.contains_any(padded, markers)

    return tx.let(F.concat(F.lit(" "), tx.squeeze(t), F.lit(" ")), marked)


def is_local(t: Column, markers: Iterable[str] = LOCAL_MARKERS) -> Column:
    padded = F.concat(F.lit(" "), tx.squeeze(t), F.lit(" "))
    return tx.let(padded, lambda p: p.rlike(r"\b(?:bc|b\.c\.)\b") | tx.contains_any(p, markers))


def quality_reason(
    row_text: Sequence[str],
    context: Column | None = None,
    social: Column | None = None,
    minimum: Column | None = None,
    nonlocal_markers: Iterable[str] = NONLOCAL_MARKERS,
    local_markers: Iterable[str] = LOCAL_MARKERS,
) -> Column:
    """Reject reason of the write gate, NULL for kept rows. First rule wins."""
    body = F.concat_ws(" ", *[tx.squeeze(c) for c in row_text], *([tx.squeeze(context)] if context is not None else []))
    social = F.lit(False) if social is None else social
    minimum = has_minimum_data() if minimum is None else minimum
    return (
        F.when(~minimum, "insufficient_event_data")
        .when(is_nonlocal(body, nonlocal_markers), "out_of_scope_location")
        .when(social & ~is_local(body, local_markers), "social_image_missing_locality")
    )


def dominant_reason(rejected: DataFrame, keys: Sequence[str], reason: str = "reject_reason") -> DataFrame:
    """Most frequent reason per batch (ties: first by name)."""
    counts = rejected.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(counts, keys, [F.desc("n"), F.asc(reason)], 1).drop("rn")


def us_postal(location: Column | str) -> Column:
    """ZIP code next to a state code, or after a US country name; '' when absent."""
    t = F.upper(F.trim(F.regexp_replace(tx.text(location), r"\s+", " ")))
    by_state = F.regexp_extract(t, rf"\b(?:{'|'.join(US_STATES)})\b[\s,]+(\d{{5}}(?:-\d{{4}})?)\b", 1)
    by_country = F.regexp_extract(t, r"\b(?:USA|U\.S\.A\.|UNITED STATES|UNITED STATES OF AMERICA)\b.*?\b(\d{5}(?:-\d{4})?)\b", 1)
    return F.when(by_state != "", by_state).otherwise(by_country)


def is_us_address(location="location", postal=None, province=None, country=None) -> Column:
    hit = us_postal(location) != ""
    if postal is not None:
        zip5 = tx.text(postal).rlike(r"^\d{5}(-\d{4})?$")
        hit = hit | (zip5 & (
            F.upper(tx.text(province)).isin(*US_STATES) | F.upper(tx.text(country)).isin("US", "USA", "UNITED STATES")
        ))
    return hit


def is_old(as_of: Column, days: int, null_policy: str = "drop") -> Column:
    """Effective date (end, else start) before ``as_of`` - days. NULL dates: drop (write form) or keep (table form)."""
    effective = F.coalesce("end_date", "start_date")
    return F.coalesce(effective < F.date_sub(as_of, days), F.lit(null_policy == "drop"))


def all_empty(cols: Iterable[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & tx.blank(c)
    return out


def enforce_event_url(df: DataFrame, default_url, parent_url, source, blocked_hosts: Iterable[str]) -> DataFrame:
    """Resolve each row's URL; adds url, keep and needs_check.

    A blocked or missing URL takes the batch URL (default, else parent), mail batches
    take a mail address, other rows are dropped. ``needs_check`` marks row URLs that
    differ from the batch's and should be probed before they are trusted.
    """
    def blocked(c):
        return tx.contains_any(u.netloc(c), blocked_hosts)

    def usable(c):
        return F.when(u.looks_http(c) & ~blocked(c), tx.text(c))

    mail = r"([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})"

    def email(c):
        return F.nullif(F.regexp_extract(F.lower(tx.text(c)), mail, 1), F.lit(""))

    row = F.when(blocked("url"), "").otherwise(tx.text("url"))
    fallback = F.coalesce(usable(default_url), usable(parent_url))
    in_mail = (
        F.lower(tx.text("source")).contains("email") | F.lower(tx.text(source)).contains("email")
        | F.lower(tx.text(parent_url)).contains("email inbox")
    )
    final = F.when(row != "", row).otherwise(
        F.coalesce(fallback, F.when(in_mail, F.coalesce(email("url"), email("source"), email(default_url), email(source))))
    )
    identities = [F.when(usable(c).isNotNull(), u.url_identity(c)) for c in (default_url, parent_url)]
    own = u.url_identity("url")
    known = F.coalesce(own == identities[0], F.lit(False)) | F.coalesce(own == identities[1], F.lit(False))
    have = F.coalesce(*identities).isNotNull()
    low_path = F.regexp_replace(F.lower(u.path("url")), "/+$", "")
    detail = (
        ~low_path.isin("", "/event", "/events")
        & ~tx.contains_any(low_path, ("/events/month", "/events/list", "/calendar", "/schedule"))
        & tx.contains_any(low_path, ("/event/", "/events/", "/show/", "/tickets/", "/nm_event/"))
    )
    affine = u.source_matches_url("source", "url") | u.source_matches_url(source, "url")
    needs = (row != "") & u.looks_http("url") & F.when(have, ~known).otherwise(~(affine & ~detail))
    return df.withColumns({"_final": final, "needs_check": needs}).withColumns(
        {"url": F.col("_final"), "keep": F.col("_final").isNotNull()}
    ).drop("_final")


def prefix_semi(df: DataFrame, roots: DataFrame, column: str = "url", root: str = "root") -> DataFrame:
    """Rows whose URL equals a root or lies under it (same scheme and host, path prefix)."""
    r = roots.select(u.url_compare_key(root).alias("_rk")).distinct()
    r = r.select(u.scheme("_rk").alias("_rs"), u.netloc("_rk").alias("_rh"), u.path("_rk").alias("_rp"))
    keyed = df.withColumn("_k", u.url_compare_key(column)).withColumns({"_s": u.scheme("_k"), "_h": u.netloc("_k"), "_p": u.path("_k")})
    cond = (F.col("_s") == F.col("_rs")) & (F.col("_h") == F.col("_rh")) & F.startswith(F.col("_p"), F.col("_rp"))
    return keyed.join(r, cond, "left_semi").drop("_k", "_s", "_h", "_p")


def is_foreign(texts: Sequence[str], countries: Iterable[str], blocked_cities: Iterable[str] = ()) -> Column:
    body = F.lower(F.concat_ws(" ", *[tx.text(c) for c in texts]))
    return tx.contains_any(body, [c.lower() for c in blocked_cities]) | tx.contains_any(body, [c.lower() for c in countries])


# Place names next to the border.
OUTSIDE_WORDS = ("usa", "washington", "oregon", "bellingham")


def outside_region(location: Column | str, words: Iterable[str] = OUTSIDE_WORDS) -> Column:
    t = tx.text(location)
    return (
        tx.contains_any(F.lower(t), words)
        | t.rlike(r"\b\d{5}(?:[-\s]\d{4})?\b")
        | t.rlike(r"\b[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}\b")
    )


def too_far_future(as_of: Column, days: int = 270) -> Column:
    return F.col("start_date") > F.date_add(as_of, days)


def dud_reason(ev: DataFrame, addr: DataFrame, province: str = "BC", country: str = "CA") -> DataFrame:
    """Adds ``reason`` for rows that carry no usable content or lie outside the region."""
    a = addr.select(F.col("address_id").alias("_aid"), F.col("province_or_state").alias("_prov"), F.col("country_id").alias("_ctry"))
    joined = ev.join(a, ev["address_id"] == a["_aid"], "left")
    reason = (
        F.when((F.col("source") == "") & (F.col("dance_style") == "") & (F.col("url") == "") & F.col("address_id").isNull(),
               "empty_source_dance_style_url_no_address")
        .when(F.col("_prov") != province, "outside_bc_filter")
        .when(F.col("_ctry") != country, "outside_canada_filter")
        .when((F.col("dance_style") == "") & (F.col("url") == "") & (F.col("event_type") == "other")
              & F.col("location").isNull() & F.col("description").isNull(),
              "empty_dance_style_url_other_no_location_description")
    )
    return joined.withColumn("reason", reason).drop("_aid", "_prov", "_ctry")


def null_times(start_date="start_date", start="start_sec", end="end_sec") -> Column:
    d, s, e = F.col(start_date), F.col(start), F.col(end)
    return (d.isNull() & s.isNull()) | (s.isNull() & e.isNull())


def matches_rules(ilike: Iterable[tuple[str, str]] = (), equals: Iterable[tuple[str, str]] = (), one_of: dict | None = None) -> Column:
    """OR of ILIKE '%x%', equality and IN-list rules; NULL columns never match."""
    out = F.lit(False)
    for c, pattern in ilike:
        out = out | F.coalesce(F.col(c).ilike(f"%{pattern}%"), F.lit(False))
    for c, value in equals:
        out = out | F.coalesce(F.col(c) == value, F.lit(False))
    for c, values in (one_of or {}).items():
        out = out | F.coalesce(F.col(c).isin(*values), F.lit(False))
    return out


def sanitize_seeds(df: DataFrame, platform: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Unwrap, drop empty and non-content links, keep the first of each link; plus one stats row."""
    link = tx.text("link")
    unwrapped = u.unwrap_next("link", platform)
    low = F.lower(u.path("_n"))
    junk = u.netloc("_n").contains(platform) & (
        low.rlike("^/(sharer/|dialog/|recover/|share[.]php)") | low.contains("sharer.php")
    )
    marked = df.withColumn("_n", unwrapped).withColumns({
        "_empty": link == "", "_changed": (link != "") & (F.col("_n") != link), "_junk": (link != "") & junk,
    })
    good = marked.filter(~F.col("_empty") & ~F.col("_junk"))
    rest = [c for c in df.columns if c != "link"]
    first = good.groupBy("_n").agg(F.min_by(F.struct(*rest), order).alias("_r"))
    clean = first.select(F.col("_n").alias("link"), *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
    per_link = marked.groupBy("_n", "_empty", "_junk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_changed").alias("changed")
    )
    kept = ~F.col("_empty") & ~F.col("_junk")
    stats = per_link.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum(F.when(F.col("_empty"), F.col("n"))), F.lit(0)).alias("empty_rows_dropped"),
        F.coalesce(F.sum("changed"), F.lit(0)).alias("canonicalized_rows"),
        F.coalesce(F.sum(F.when(F.col("_junk"), F.col("n"))), F.lit(0)).alias("non_content_rows_dropped"),
        F.coalesce(F.sum(F.when(kept, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows_dropped"),
        F.count_if(kept).alias("output_rows"),
    )
    return clean, stats


def partition_seeds(df: DataFrame, decisions: DataFrame, key: str, skip_reasons: dict[str, str]) -> DataFrame:
    """Adds decision_reason and ``outcome``: kept, or the counter name of a skip reason."""
    d = decisions.select(F.col(key).alias("_k"), "decision_reason", "process")
    joined = df.join(d, df[key] == d["_k"], "left").drop("_k")
    outcome = F.lit(None).cast("string")
    for reason, counter in skip_reasons.items():
        outcome = F.when(F.col("decision_reason") == reason, counter).otherwise(outcome)
    return joined.withColumn("outcome", F.when(~F.col("process"), outcome)).withColumn(
        "outcome", F.coalesce("outcome", F.lit("kept_rows"))
    )


def overtagged(tags: Column | str, evidence: Sequence[str], vocabulary: Iterable[str], limit: int) -> Column:
    """More than ``limit`` tags and none of the vocabulary in the text."""
    body = F.lower(F.concat_ws(" ", *[tx.text(c) for c in evidence]))
    count = F.size(F.filter(F.split(tx.text(tags), ","), lambda t: F.trim(t) != ""))
    return (count > limit) & ~tx.contains_any(body, vocabulary)


def has_event_signal(body: Column | str, tokens: Iterable[str] = EVENT_SIGNALS) -> Column:
    return tx.contains_any(F.lower(tx.text(body)), tokens)


def is_active_source(as_of: Column, enabled="enabled", start="active_start_date", end="active_end_date") -> Column:
    """Struct (active, reason): switched on and inside the seasonal window."""
    off = F.lower(tx.text(enabled)).isin("false", "0", "no", "n", "off")
    reason = (
        F.when(off, "disabled")
        .when(as_of < F.col(start), "before_active_start_date")
        .when(as_of > F.col(end), "after_active_end_date")
        .otherwise("active")
    )
    return F.struct((reason == "active").alias("active"), reason.alias("reason"))


REQUIRED_ADDRESS = ("full_address", "street_number", "street_name", "city", "province_or_state", "postal_code", "country_id")


def incomplete_address(cols: Iterable[str] = REQUIRED_ADDRESS) -> Column:
    return F.exists(F.array(*[tx.text(c) for c in cols]), lambda v: v == "")


def problem_rows(df: DataFrame, max_name: int = 100, min_location: int = 20) -> DataFrame:
    """Rows to repair, with a group key over (name, description, location) and a wholly-empty flag.

    Group members stay rows (no collected id lists): one repair per ``group_key``, then
    a join back on it.
    """
    problem = (
        F.col("address_id").isNull() | (F.col("address_id") == 0) | F.col("location").isNull()
        | (F.length(F.trim("location")) < min_location) | (F.length(F.coalesce("event_name", F.lit(""))) > max_name)
    )
    key = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("\u0000")).alias(c) for c in ("event_name", "description", "location")])), 256)
    return df.filter(problem).withColumns({
        "group_key": key,
        "empty": tx.blank("event_name") & tx.blank("description") & tx.blank("location"),
    })


def problem_groups(problems: DataFrame) -> DataFrame:
    return problems.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_event_id"), F.bool_and("empty").alias("empty")
    )


def stale_urls(df: DataFrame, link: str, stamp: str, parts: Sequence[str], as_of: Column, days: int) -> DataFrame:
    """One row of counts of links that contain a part and are older than ``days``."""
    old = df.filter(F.col(stamp) < F.date_sub(as_of, days).cast("timestamp_ntz")).filter(tx.contains_any(F.col(link), parts))
    return old.agg(
        F.count(F.lit(1)).alias("total_count"), *[F.count_if(F.col(link).contains(p)).alias(f"{p}_count") for p in parts]
    )


def split_bad_stamp(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose stamp parses, rows for review)."""
    from ..functions.dates import parse_event_ts

    parsed = df.withColumn("parsed_stamp", parse_event_ts(column))
    return parsed.filter(F.col("parsed_stamp").isNotNull()), parsed.filter(F.col("parsed_stamp").isNull()).drop("parsed_stamp")


def low_quality_location_penalty(c: Column | str, points: float = 5.0) -> Column:
    """Negative points for location text that must not become canonical."""
    return F.when(tx.low_quality_location(c), -points).otherwise(0.0)
