"""Date, time-of-day and weekday column expressions. Times of day are integer seconds."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, text

# Weekday names, Monday first (weekday() numbering).
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Weekday fields that only restate the date.
RELATIVE_WEEKDAYS = ("today", "tomorrow", "yesterday", "tonight", "tonite")
RECURRENCE = (
    r"\b(every|weekly|recurs?|each|mondays?|tuesdays?|wednesdays?|thursdays?|fridays?|saturdays?|sundays?)\b"
)


def weekday_name(d: Column | str) -> Column:
    return F.get(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(col(d)))


def weekday_index(name: Column | str) -> Column:
    """0..6 (Monday first) for a weekday name, else NULL."""
    pos = F.array_position(F.array(*[F.lit(w.lower()) for w in WEEKDAYS]), F.lower(text(name)))
    return F.when(pos > 0, (pos - 1).cast("int"))


def month_number(token: Column) -> Column:
    pos = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(token, 1, 3)))
    return F.when(pos > 0, pos.cast("int"))


def try_make_date(year: Column, month: Column, day: Column) -> Column:
    """Date, or NULL where the parts are not a calendar day."""
    iso = F.concat_ws(
        "-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
    )
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso.try_cast("date"))


def day_seconds(ts: Column | str) -> Column:
    c = col(ts)
    return (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("int")


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a zone-free stamp, independent of the session zone."""
    c = col(ts)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + day_seconds(c)


def clock(sec: Column | str) -> Column:
    """HH:mm:ss text of seconds of day."""
    s = col(sec)
    return F.concat_ws(
        ":",
        F.lpad(F.floor(s / 3600).cast("string"), 2, "0"),
        F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"),
        F.lpad((s % 60).cast("string"), 2, "0"),
    )


def parse_event_ts(c: Column | str, zone: str = "America/Los_Angeles") -> Column:
    """Zone-free local stamp from ISO or month/day/year text; zoned stamps are converted to ``zone``, bad text gives NULL."""
    def parse(t):
        iso = F.regexp_replace(t, r"^(\d{2})/(\d{2})/(\d{4})", "$3-$1-$2")
        offset = F.regexp_extract(t, r"\d{2}:\d{2}[\d:.]*\s*(Z|[+-]\d{2}:?\d{2})$", 1)
        named = F.when(offset == "Z", "UTC").otherwise(F.regexp_replace(offset, r"^([+-]\d{2})(\d{2})$", "$1:$2"))
        local = iso.try_cast("timestamp_ntz")
        return F.when(offset != "", F.convert_timezone(named, F.lit(zone), local)).otherwise(local)

    return let(text(c), parse)


def time_norm(c: Column | str) -> Column:
    """HH:mm:ss from 12 h or 24 h text; other text is returned unchanged."""
    t = F.upper(text(c))
    h12 = r"^(0?[1-9]|1[0-2]):([0-5]\d)(?::([0-5]\d))?\s*([AP]M)$"
    h24 = r"^([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?"
    hour12 = F.regexp_extract(t, h12, 1).try_cast("int") % 12 + F.when(F.regexp_extract(t, h12, 4) == "PM", 12).otherwise(0)

    def fmt(hour, pattern):
        sec = F.regexp_extract(t, pattern, 3)
        return F.concat_ws(
            ":", F.lpad(hour.cast("string"), 2, "0"), F.regexp_extract(t, pattern, 2), F.when(sec == "", "00").otherwise(sec)
        )

    return (
        F.when(t == "", "")
        .when(t.rlike(h12), fmt(hour12, h12))
        .when(t.rlike(h24), fmt(F.regexp_extract(t, h24, 1).try_cast("int"), h24))
        .otherwise(text(c))
    )


def clock_seconds(c: Column | str) -> Column:
    t = col(c)
    ok = t.rlike(r"^\d{2}:\d{2}:\d{2}")
    return F.when(
        ok,
        F.substring(t, 1, 2).try_cast("int") * 3600 + F.substring(t, 4, 2).try_cast("int") * 60 + F.substring(t, 7, 2).try_cast("int"),
    )


def times_equal_12h(a: Column | str, b: Column | str) -> Column:
    """Equal, or exactly twelve hours apart (AM/PM slip); a missing side equals only a missing side."""
    x, y = text(a), text(b)
    gap = F.abs(clock_seconds(x) - clock_seconds(y))
    return F.when((x == "") | (y == ""), x == y).otherwise((x == y) | F.coalesce(gap == 43200, F.lit(False)))


def clean_weekday(c: Column | str) -> Column:
    """First name of a list; 'daily' forms become ''; known names are capitalised."""
    t, low = text(c), F.lower(text(c))
    return (
        F.when(t == "", col(c))
        .when(t.contains(","), F.trim(F.substring_index(t, ",", 1)))
        .when(low.isin("daily", "every day", "everyday"), "")
        .when(weekday_index(t).isNotNull(), F.initcap(low))
        .otherwise(col(c))
    )


def has_recurrence(*texts: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *[text(t) for t in texts])).rlike(RECURRENCE)


def nearest_weekday_shift(d: Column | str, name: Column | str) -> Column:
    """Days to the nearest such weekday (-3..3); 0 for an unknown name."""
    f = F.pmod(weekday_index(name) - F.weekday(col(d)), F.lit(7))
    return F.coalesce(F.when(f <= 3, f).otherwise(f - 7), F.lit(0)).cast("int")


#: Full and short month names, the longer ones first; September also has a short name of four letters.
MONTH_PATTERN = "|".join(sorted({*calendar.month_name[1:], *calendar.month_abbr[1:], "Sept"}, key=lambda m: (-len(m), m))).lower()


def candidate_dates(c: Column | str, as_of: Column, primary: Column | None = None) -> Column:
    """Dates mentioned as 'month day[, year]' in order of mention, distinct.

    A mention without a year takes the year of ``as_of``, or the next year when that
    day is more than 90 days past. ``primary``, a date detected in the picture itself,
    comes first if no mention has it.
    """
    low = F.lower(text(c))
    mention = rf"\b((?:{MONTH_PATTERN})[\s,/-]+\d{{1,2}}(?:st|nd|rd|th)?(?:[\s,/-]+20\d{{2}})?)\b"
    hits = F.regexp_extract_all(low, F.lit(mention), F.lit(1))

    def resolve(m):
        month = month_number(F.substring(m, 1, 3))
        day = F.regexp_extract(m, r"^[a-z]+[\s,/-]+(\d{1,2})", 1)
        year = F.regexp_extract(m, r"(20\d{2})$", 1)
        guess = try_make_date(F.year(as_of), month, day)
        rolled = F.when(F.datediff(as_of, guess) > 90, try_make_date(F.year(as_of) + 1, month, day)).otherwise(guess)
        return F.when(year != "", try_make_date(year, month, day)).otherwise(rolled)

    dates = F.array_distinct(F.array_compact(F.transform(hits, resolve)))
    if primary is None:
        return dates
    return F.when(primary.isNull() | F.array_contains(dates, F.coalesce(primary, as_of)), dates).otherwise(F.concat(F.array(primary), dates))


def poster_type(c: Column | str, dates: Column, primary: Column | None = None) -> Column:
    """single_event / schedule_multi_event / unknown from the counts of dates, weekdays and months, and the detected date."""
    low = F.lower(text(c))
    days = F.regexp_count(low, F.lit(r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun)\b"))
    months = F.regexp_count(low, F.lit(rf"\b(?:{MONTH_PATTERN})\b"))
    n = F.size(dates)
    return (
        F.when((n >= 3) | ((n >= 2) & (days >= 3) & (months >= 1)), "schedule_multi_event")
        .when((n == 1) | (F.lit(False) if primary is None else primary.isNotNull()), "single_event")
        .otherwise("unknown")
    )


def poster_date(dates: Column, kind: Column, primary: Column) -> Column:
    """The one date of a single-event poster: the detected one, else the one in its text; NULL for other posters."""
    return F.when(kind == "single_event", F.coalesce(primary, F.get(dates, F.lit(0))))


def header_date(c: Column | str) -> Column:
    """Absolute date in a page header ('Friday 5 June 2026 from', 'June 5, 2026 at').

    The most frequent date wins; a tie gives NULL.
    """
    return let(F.regexp_replace(F.lower(text(c)), r"\s+", " "), _header_date)


def _header_date(low: Column) -> Column:
    days = "|".join(w.lower() for w in WEEKDAYS)
    dmy = F.regexp_extract_all(low, F.lit(rf"\b(?:{days}) (\d{{1,2}} [a-z]+ \d{{4}}) from\b"), F.lit(1))
    # a mention with its weekday is found by two of the patterns and so counts twice
    mdy_day = F.regexp_extract_all(
        low, F.lit(rf"\b(?:{days}) ?,? ([a-z]+ \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}) (?:at|from)\b"), F.lit(1)
    )
    mdy = F.regexp_extract_all(low, F.lit(r"\b([a-z]+ \d{1,2}(?:st|nd|rd|th)?,? \d{4}) (?:at|from)\b"), F.lit(1))

    def is_month(tok):
        return tok.rlike(rf"^(?:{MONTH_PATTERN})$")

    def from_dmy(m):
        mon = F.regexp_extract(m, r"^\d{1,2} ([a-z]+)", 1)
        return F.when(is_month(mon), try_make_date(F.regexp_extract(m, r"(\d{4})$", 1), month_number(mon), F.regexp_extract(m, r"^(\d{1,2})", 1)))

    def from_mdy(m):
        mon = F.regexp_extract(m, r"^([a-z]+)", 1)
        return F.when(is_month(mon), try_make_date(F.regexp_extract(m, r"(\d{4})$", 1), month_number(mon), F.regexp_extract(m, r"^[a-z]+ (\d{1,2})", 1)))

    found = F.array_compact(F.concat(F.transform(dmy, from_dmy), F.transform(mdy_day, from_mdy), F.transform(mdy, from_mdy)))

    def most_frequent(dates):
        counted = F.transform(
            F.array_distinct(dates), lambda d: F.struct(F.size(F.filter(dates, lambda x: x == d)).alias("n"), d.alias("d"))
        )
        return let(counted, lambda c: let(
            F.filter(c, lambda s: s["n"] == F.array_max(F.transform(c, lambda t: t["n"]))),
            lambda best: F.when(F.size(best) == 1, F.get(best, F.lit(0))["d"]),
        ))

    return let(found, most_frequent)
