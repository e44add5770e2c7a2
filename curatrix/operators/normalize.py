"""Row normalizers that need more than one column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u

# Registered delete reasons.
DELETE_REASONS = (
    "orphaned_address_id_reference", "exact_time_window_duplicate", "fuzzy_duplicate_merged",
    "empty_source_dance_style_url_no_address", "outside_bc_filter", "outside_canada_filter",
    "empty_dance_style_url_other_no_location_description", "manual_delete_by_name_and_start_date",
    "null_start_date_start_time_or_null_start_end_time",
)
# Page texts of login walls, temporary blocks and removed pages.
LOGIN_WORDS = ("must log in", "you must log in", "two-factor", "enter the code")
BLOCKED_WORDS = (
    "temporarily blocked", "misusing this feature", "too many requests", "try again later", "rate limited",
    "you are temporarily blocked",
)
# Patterns of a temporary block, in any case; a dot also meets line ends.
TEMP_BLOCK_PATTERNS = (
    r"\byou[’']?re\s+temporarily\s+blocked\b",
    r"\byou[’']?ve\s+been\s+temporarily\s+blocked\b",
    r"\bmisusing\s+this\s+feature\b.*\bgoing\s+too\s+fast\b",
    r"\btemporar(?:ily|y)\s+blocked\b.*\b(using\s+this\s+feature|from\s+using\s+it)\b",
    r"\btoo\s+many\s+requests\b",
    r"\btry\s+again\s+later\b",
    r"\brate\s*[- ]?limit(?:ed|ing)?\b",
)
UNAVAILABLE_WORDS = (
    "this content isn't available", "this page isn't available", "this content is unavailable", "may have been removed",
)


def normalize_nulls(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: tx.null_words_to_null(c) for c in cols})


def evidence_tags(df: DataFrame, vocabulary, applies: Column, evidence: Iterable[str], out: str) -> DataFrame:
    """Where ``applies``, keep only tags that the evidence columns spell out; NULL when none."""
    body = F.lower(F.concat_ws(" ", *[tx.text(c) for c in evidence]))
    return df.withColumn(out, F.when(applies, tx.evidence_terms(body, vocabulary)).otherwise(F.col(out)))


def canadian_postal_code(c: Column | str) -> Column:
    """First A1A 1A1 code, upper case with one space; NULL when absent."""
    raw = F.regexp_extract(tx.text(c), r"([A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d)", 1)
    code = F.upper(F.regexp_replace(raw, r"\s", ""))
    return F.when(raw != "", F.concat(F.substring(code, 1, 3), F.lit(" "), F.substring(code, 4, 3)))


def build_full_address(df: DataFrame) -> Column:
    """Building, street line, city, province with postal code, country; blanks left out."""
    have = set(df.columns)

    def get(c):
        return tx.filled(c) if c in have else F.lit(None).cast("string")

    street = F.concat_ws(" ", *[get(c) for c in ("street_number", "direction", "street_name", "street_type")])
    region = F.concat_ws(" ", get("province_or_state"), get("postal_code"))
    return F.concat_ws(
        ", ", get("building_name"), tx.filled(street), get("city"), tx.filled(region), get("country_id")
    )


STREET_TYPES = "Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Way|Lane|Ln|Boulevard|Blvd"


def split_full_address(c: Column | str) -> Column:
    """Struct of number, street, type, city, province and postal code from one address line."""
    t = tx.text(c)
    street = rf"(?i)(\d+)\s+([A-Za-z][A-Za-z .'-]*?)\s+({STREET_TYPES})\b\.?"

    def ex(pattern, n):
        return F.nullif(F.regexp_extract(t, pattern, n), F.lit(""))

    return F.struct(
        ex(street, 1).alias("street_number"),
        ex(street, 2).alias("street_name"),
        ex(street, 3).alias("street_type"),
        ex(rf"(?i)\d+\s+[^,]*,\s*([^,]+),", 1).alias("city"),
        ex(r",\s*([A-Z]{2})(?:\s+[A-Z]\d[A-Z]\s?\d[A-Z]\d)?\s*(?:,|$)", 1).alias("province_or_state"),
        canadian_postal_code(t).alias("postal_code"),
    )


def delete_reason_code(c: Column | str) -> Column:
    """Struct (code, raw, registered) in the controlled vocabulary of delete reasons."""
    raw = F.lower(tx.text(c))
    aged = raw.rlike(r"^end_date_older_than_.*_days$")
    known = raw.isin(*DELETE_REASONS)
    return F.struct(
        F.when(aged, "end_date_older_than_days").when(known, raw).otherwise("unregistered_delete_reason").alias("code"),
        raw.alias("raw"),
        (aged | known).alias("registered"),
    )


def visible_text_native(c: Column | str) -> Column:
    """Visible text by patterns only; keeps the whole text and stays in the JVM."""
    hidden = (
        r"(?is)<(script|style|noscript|template|svg)[^>]*>.*?</(script|style|noscript|template|svg)>|<!--.*?-->"
    )
    bare = F.regexp_replace(F.regexp_replace(tx.col(c), hidden, " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


#: Target of an anchor, in either quotes or without.
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def hrefs(html: Column) -> Column:
    """Anchor targets of a page as they are written, in page order."""
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda h: F.regexp_replace(h, r"""^["']|["']$""", ""))


def page_links(pages: DataFrame, key: str) -> DataFrame:
    """(key, pos, link): links of each page joined with its url, http(s) only, distinct, in page order."""
    absolute = F.transform(hrefs(F.col("html")), lambda h: u.url_join(F.col("url"), h))
    links = F.array_distinct(F.filter(absolute, lambda h: h.rlike("(?i)^https?://")))
    return pages.select(key, "url", F.posexplode(links).alias("pos", "link"))


def sanitize_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Coerce text columns to the target types; bad values and null words become NULL."""
    out = {}
    for name, kind in types.items():
        clean = tx.null_words_to_null(name)
        if kind in ("int", "bigint"):
            number = clean.try_cast("double")
            out[name] = F.when(number == F.floor(number), number.cast(kind))
        elif kind == "string":
            out[name] = clean.cast("string")
        else:
            out[name] = clean.try_cast(kind)
    return df.withColumns(out)


def poster_signature(source, kind: Column, primary: Column, dates: Column, body) -> Column:
    """Stable signature of a poster: source, type, dates and the hash of its squeezed text."""
    return F.sha1(F.concat_ws(
        "|", F.lower(tx.text(source)), kind, F.coalesce(primary, F.lit("")), F.array_join(dates, ","),
        F.sha1(tx.squeeze(body)),
    ))


def access_state(url, body, login_paths=("/login",), blocked_words=BLOCKED_WORDS) -> Column:
    """Struct (state, reason): ok, login or blocked, by ordered URL and text rules."""
    low, t = F.lower(tx.text(url)), F.lower(tx.text(body))
    rules = [
        (low.contains("/checkpoint/"), "blocked", "checkpoint_url"),
        (low.contains("/challenge/"), "blocked", "challenge_url"),
        (tx.contains_any(low, login_paths), "login", "login_url"),
        (low.contains("/sorry/"), "blocked", "sorry_url"),
        (t.contains('name="email"') & t.contains('name="pass"'), "login", "login_form_detected"),
        (tx.contains_any(t, LOGIN_WORDS), "login", "login_gate_text"),
        (t.rlike("(?is)" + "|".join(TEMP_BLOCK_PATTERNS)), "blocked", "explicit_temp_block_regex"),
        (tx.contains_any(t, blocked_words), "blocked", "rate_limit_or_temp_block_text"),
        (tx.contains_any(t, UNAVAILABLE_WORDS), "blocked", "private_or_unavailable_content"),
    ]
    state, reason = F.lit("ok"), F.lit("accessible")
    for cond, s, r in reversed(rules):
        state, reason = F.when(cond, s).otherwise(state), F.when(cond, r).otherwise(reason)
    return F.struct(state.alias("state"), reason.alias("reason"))
