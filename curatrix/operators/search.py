"""Answering many event searches at once: phrase calendar, question tags, constraint join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import text as tx
from .keyed import top_by_limit

# Parts of the day in seconds (start, end); NULL for open.
DAY_PERIODS = {"morning": (21600, 43200), "afternoon": (43200, 61200), "evening": (61200, 75600), "night": (64800, None)}
EVENING = 64800
# Dance styles and their spellings.
STYLE_SYNONYMS = {
    "west coast swing": ("west coast swing", "wcs"), "east coast swing": ("east coast swing", "ecs"), "salsa": ("salsa",),
    "bachata": ("bachata",), "kizomba": ("kizomba",), "tango": ("tango", "argentine tango"), "argentine tango": ("argentine tango", "tango"),
    "lindy hop": ("lindy hop", "lindy"), "lindy": ("lindy", "lindy hop"), "zouk": ("zouk",),
}
# Event types and their words.
TYPE_WORDS = {
    "social dance": ("social dance", "social dances", "social"), "class": ("class", "classes", "lesson", "lessons"),
    "workshop": ("workshop", "workshops"), "live music": ("live music", "live band", "live bands"),
}
ALL_STYLES = ("all dance events", "all dances", "all styles", "any dance style", "any styles", "not just", "not only")


def _phrases(a: Column) -> list[tuple[str, Column, Column, int | None, int | None]]:
    """(phrase, start, end, time from, time to) as expressions over the anchor date."""
    sunday = F.date_sub(a, F.dayofweek(a) - 1)
    friday = F.date_add(a, F.pmod(F.lit(4) - F.weekday(a), F.lit(7)).cast("int"))
    monday = F.date_sub(a, F.weekday(a))
    month, year = F.trunc(a, "month"), F.trunc(a, "year")

    def months(n):
        first = F.add_months(month, n)
        return first, F.last_day(first)

    def years(n):
        first = F.add_months(year, 12 * n)
        return first, F.date_sub(F.add_months(first, 12), 1)

    def plus(n):
        return F.date_add(a, n)

    out = [
        ("today", a, a, None, None), ("tonight", a, a, EVENING, None), ("tomorrow", plus(1), plus(1), None, None),
        ("tomorrow night", plus(1), plus(1), EVENING, None), ("yesterday", plus(-1), plus(-1), None, None),
        ("this week", a, F.date_add(sunday, 6), None, None), ("next week", F.date_add(sunday, 7), F.date_add(sunday, 13), None, None),
        ("this weekend", friday, F.date_add(friday, 2), EVENING, 86399), ("coming weekend", friday, F.date_add(friday, 2), EVENING, 86399),
        ("next weekend", F.date_add(monday, 11), F.date_add(monday, 13), None, None),
        ("this month", *months(0), None, None), ("next month", *months(1), None, None), ("last month", *months(-1), None, None),
        ("this year", *years(0), None, None), ("next year", *years(1), None, None), ("last year", *years(-1), None, None),
        ("upcoming week", a, plus(6), None, None), ("upcoming 30 days", a, plus(29), None, None), ("upcoming events", a, plus(29), None, None),
    ]
    for i, name in enumerate(w.lower() for w in dt.WEEKDAYS):
        ahead = F.pmod(F.lit(i) - F.weekday(a), F.lit(7)).cast("int")
        back = F.pmod(F.weekday(a) - F.lit(i), F.lit(7)).cast("int")
        here, prev = F.date_add(a, ahead), F.date_sub(a, F.when(back == 0, 7).otherwise(back))
        out += [(name, here, here, None, None), (f"this {name}", here, here, None, None),
                (f"next {name}", F.date_add(monday, 7 + i), F.date_add(monday, 7 + i), None, None), (f"last {name}", prev, prev, None, None)]
        out += [(f"{name} {period}", here, here, lo, hi) for period, (lo, hi) in DAY_PERIODS.items()]
    return out


def phrase_calendar(anchors: DataFrame, anchor: str = "anchor") -> DataFrame:
    """(anchor, phrase, start_date, end_date, time_from, time_to) for every anchor and supported phrase.

    'before X' ends the day before X starts; 'after X' covers the year after X ends. The
    rows of an anchor come from one expression, so the table grows by rows, not joins.
    """
    a = F.col(anchor)

    def row(phrase, start, end, lo, hi):
        return F.struct(
            F.lit(phrase).alias("phrase"), start.alias("start_date"), end.alias("end_date"),
            F.lit(lo).cast("int").alias("time_from"), F.lit(hi).cast("int").alias("time_to"),
        )

    base = F.array(*[row(*p) for p in _phrases(a)])
    direct = anchors.select(a).distinct().select(anchor, F.explode(base).alias("p")).select(anchor, "p.*")
    upcoming = F.startswith("phrase", F.lit("upcoming"))
    wrapped = F.when(upcoming, F.array(F.struct(*[F.col(c) for c in ("phrase", "start_date", "end_date", "time_from", "time_to")]))).otherwise(F.array(
        F.struct("phrase", "start_date", "end_date", "time_from", "time_to"),
        F.struct(F.concat(F.lit("before "), "phrase").alias("phrase"), F.lit("1900-01-01").cast("date").alias("start_date"),
                 F.date_sub("start_date", 1).alias("end_date"), F.lit(None).cast("int").alias("time_from"), F.lit(None).cast("int").alias("time_to")),
        F.struct(F.concat(F.lit("after "), "phrase").alias("phrase"), F.date_add("end_date", 1).alias("start_date"),
                 F.date_add("end_date", 365).alias("end_date"), F.lit(None).cast("int").alias("time_from"), F.lit(None).cast("int").alias("time_to")),
    ))
    return direct.select(anchor, F.explode(wrapped).alias("p")).select(anchor, "p.*")


def phrase_names() -> list[str]:
    """All supported phrases, longest first."""
    base = [p[0] for p in _phrases(F.current_date())]
    wrapped = [f"{w} {p}" for p in base if not p.startswith("upcoming") for w in ("before", "after")]
    return sorted(base + wrapped, key=lambda p: (-len(p), p))


def question_phrase(question: Column | str) -> Column:
    """Longest supported phrase that occurs as whole words; NULL when none."""
    low = F.lower(tx.text(question))
    words = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" "))
    padded = F.array(*[F.lit(f" {p} ") for p in phrase_names()])
    return tx.let(words, lambda w: F.trim(F.get(F.filter(padded, lambda p: F.contains(w, p)), F.lit(0))))


# Ordinals of a week within its month.
WEEK_ORDINALS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4, "fifth": 5, "5th": 5}
_MONTH = f"(?:{dt.MONTH_PATTERN})"
_ORDINAL = "|".join(WEEK_ORDINALS)
_MONTH_DAY = rf"{_MONTH}\s+\d{{1,2}}(?:,?\s+\d{{4}})?"
#: Dated forms in the order in which a question is searched for them.
_DATED = (
    r"\d{4}-\d{2}-\d{2}",
    rf"(?:the\s+)?(?:{_ORDINAL})\s+week\s+(?:of|in)\s+(?:{_MONTH}|this month|next month|last month)(?:\s+\d{{4}})?",
    _MONTH_DAY,
    rf"\d{{1,2}}\s+{_MONTH}(?:\s+\d{{4}})?",
    r"\d{1,2}/\d{1,2}(?:/\d{4})?",
    rf"{_MONTH}(?:\s+\d{{4}})?",
)
_SPAN = rf"\b(?:between\s+.+?\s+and\s+.+|from\s+.+?\s+to\s+.+|{_MONTH_DAY}\s+to\s+{_MONTH_DAY})\b"


def _plain(question: Column | str) -> Column:
    """Lower-cased, with single blanks and without signs at its ends."""
    low = F.regexp_replace(F.lower(tx.text(question)), r"\s+", " ")
    return F.regexp_replace(low, r"""^[ .,!?:;"']+|[ .,!?:;"']+$""", "")


def dated_phrase(plain: Column) -> Column:
    """The date, month, or week of a month that a text names; the most exact form first, NULL when none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(plain, rf"\b(?:{form})\b", 0), F.lit("")) for form in _DATED])


def dated_range(phrase: Column, anchor: Column) -> Column:
    """Struct (start_date, end_date) of a dated phrase, also after 'before' or 'after'; NULL for any other.

    A form without a year takes the year of ``anchor``. A date that does not exist, or a
    week that its month does not have, is NULL.
    """
    def year(y):
        return F.when(y == "", F.year(anchor)).otherwise(y.try_cast("int"))

    def dated(p):
        def find(pattern, *groups):
            return [F.regexp_extract(p, pattern, g) for g in groups]

        iso = F.when(p.rlike(r"^\d{4}-\d{2}-\d{2}$"), p.try_cast("date"))
        m, d, y = find(r"^(\d{1,2})/(\d{1,2})(?:/(\d{4}))?$", 1, 2, 3)
        slash = F.when(m != "", dt.try_make_date(year(y), m, d))
        m, d, y = find(rf"^({_MONTH})\s+(\d{{1,2}})(?:,?\s+(\d{{4}}))?$", 1, 2, 3)
        month_day = F.when(m != "", dt.try_make_date(year(y), dt.month_number(F.substring(m, 1, 3)), d))
        d, m, y = find(rf"^(\d{{1,2}})\s+({_MONTH})(?:\s+(\d{{4}}))?$", 1, 2, 3)
        day_month = F.when(m != "", dt.try_make_date(year(y), dt.month_number(F.substring(m, 1, 3)), d))
        day = F.coalesce(iso, slash, month_day, day_month)
        o, m, y = find(rf"^(?:the\s+)?({_ORDINAL})\s+week\s+(?:of|in)\s+({_MONTH}|this month|next month|last month)(?:\s+(\d{{4}}))?$", 1, 2, 3)
        here = F.trunc(anchor, "month")
        relative = F.when(m == "this month", here).when(m == "next month", F.add_months(here, 1)).when(m == "last month", F.add_months(here, -1))
        first = F.when(o != "", F.coalesce(relative, dt.try_make_date(year(y), dt.month_number(F.substring(m, 1, 3)), F.lit(1))))
        number = F.element_at(F.create_map(*[F.lit(x) for kv in WEEK_ORDINALS.items() for x in kv]), o)
        week = F.date_add(first, (number - 1) * 7)
        week = F.when(week <= F.last_day(first), week)
        m, y = find(rf"^({_MONTH})(?:\s+(\d{{4}}))?$", 1, 2)
        month = F.when(m != "", dt.try_make_date(year(y), dt.month_number(F.substring(m, 1, 3)), F.lit(1)))
        start = F.coalesce(day, week, month)
        end = F.coalesce(day, F.least(F.date_add(week, 6), F.last_day(first)), F.last_day(month))
        return F.struct(start.alias("start_date"), end.alias("end_date"))

    inner = F.regexp_replace(phrase, "^(?:before|after) ", "")

    def wrapped(r):
        before, after = phrase.startswith("before "), phrase.startswith("after ")
        start = F.when(before, F.lit("1900-01-01").cast("date")).when(after, F.date_add(r["end_date"], 1)).otherwise(r["start_date"])
        end = F.when(before, F.date_sub(r["start_date"], 1)).when(after, F.date_add(r["end_date"], 365)).otherwise(r["end_date"])
        return F.when(r["start_date"].isNotNull(), F.struct(start.alias("start_date"), end.alias("end_date")))

    return tx.let(inner, lambda p: tx.let(dated(p), wrapped))


def question_ranges(questions: DataFrame, question: str, anchor: str) -> DataFrame:
    """Adds phrase, start_date, end_date, time_from and time_to: the time that a question asks for, relative to its anchor date.

    Looked for, in this order: a range ('between A and B', 'from A to B', 'month day to
    month day'), a dated form (see ``dated_range``), the longest phrase of the calendar.
    The ends of a range are phrases themselves, in either order. Phrases meet the calendar
    by equality. A question without a phrase, or with one that has no dates, keeps its row
    with NULLs.
    """
    c = F.col
    span = F.regexp_extract("_q", _SPAN, 0)

    def side(k):
        cut = F.when(c("_span").startswith("between "), F.regexp_extract("_span", r"^between\s+(.+?)\s+and\s+(.+)$", k)).when(
            c("_span").startswith("from "), F.regexp_extract("_span", r"^from\s+(.+?)\s+to\s+(.+)$", k)).otherwise(F.regexp_extract("_span", r"^(.+?)\s+to\s+(.+)$", k))
        return _plain(cut)

    def phrase(text):
        return tx.let(text, lambda t: F.coalesce(dated_phrase(t), question_phrase(t)))

    base = questions.withColumn("_q", _plain(question)).withColumn("_span", span).withColumn("_a", F.to_date(anchor))
    ranged = c("_span") != ""
    base = base.withColumns({"_from": phrase(F.when(ranged, side(1)).otherwise(c("_q"))), "_to": F.when(ranged, phrase(side(2)))})
    calendar = phrase_calendar(base.select("_a").filter("_a is not null"), "_a")
    for end in ("_from", "_to"):
        known = calendar.select(c("_a").alias(f"{end}_a"), c("phrase").alias(f"{end}_p"), F.struct("start_date", "end_date", "time_from", "time_to").alias(f"{end}_r"))
        base = base.join(known, (c("_a") == c(f"{end}_a")) & (c(end) == c(f"{end}_p")), "left")
        base = base.withColumn(f"{end}_d", dated_range(c(end), c("_a")))
    start, end = (F.coalesce(c(f"{e}_d.{f}"), c(f"{e}_r.{f}")) for e, f in (("_from", "start_date"), ("_from", "end_date")))
    other = F.coalesce(c("_to_d.end_date"), c("_to_r.end_date"))
    both = start.isNotNull() & other.isNotNull()
    return base.select(
        *questions.columns, F.when(ranged, c("_span")).otherwise(c("_from")).alias("phrase"),
        F.when(ranged, F.when(both, F.least(start, other))).otherwise(start).alias("start_date"),
        F.when(ranged, F.when(both, F.greatest(start, other))).otherwise(end).alias("end_date"),
        F.when(~ranged, c("_from_r.time_from")).alias("time_from"), F.when(~ranged, c("_from_r.time_to")).alias("time_to"),
    )


# bounded look-behinds: words that negate a mention directly before it
_NEGATED = r"(?:\bnot\s{1,8}(?:just|only)?\s{0,8}|\bno\s{1,8}|\bwithout\s{1,8}|\bexclud(?:e|ing)\s{1,8}|\bexcept\s{1,8})"
_EXCLUDED = r"(?:\bnot\s{1,8}|\bno\s{1,8}|\bwithout\s{1,8}|\bexclud(?:e|ing)\s{1,8}|\bexcept\s{1,8})"
_NEAR = ("no ", "not ", "without ", "exclude ")


def question_tags(question: Column | str) -> Column:
    """Struct of include_styles, exclude_styles, include_types, exclude_types, weekdays and limit of a question.

    What is excluded is not included as well.
    """
    return tx.let(F.lower(tx.text(question)), _tags)


def _tags(low: Column) -> Column:
    everything = tx.contains_any(low, ALL_STYLES)

    def any_word(words, look=None):
        # the look-behind stands after the word, so it only runs where the word occurs
        return low.rlike("|".join(rf"\b{w}\b" + (f"{look[0]}{look[1]}{w})" if look else "") for w in words))

    def collect(pairs):
        return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))

    include = collect([(s, any_word(syn, ("(?<!", _NEGATED))) for s, syn in STYLE_SYNONYMS.items()])
    exclude = collect([(s, any_word(syn, ("(?<=", _EXCLUDED))) for s, syn in STYLE_SYNONYMS.items()])
    types = collect([(t, any_word(ws)) for t, ws in TYPE_WORDS.items()])
    def negated(word):
        # a negation within the 24 characters before the first mention
        pos = F.regexp_instr(low, F.lit(rf"\b{word}\b"))
        return (pos > 0) & tx.contains_any(F.substring(low, F.greatest(pos - 24, F.lit(1)), F.least(pos - 1, F.lit(24))), _NEAR)

    def any_negated(words):
        out = F.lit(False)
        for w in words:
            out = out | negated(w)
        return out

    no_types = collect([(t, any_negated(ws)) for t, ws in TYPE_WORDS.items()])
    days = collect([(i, low.rlike(rf"\b{w.lower()}s\b|\b(?:every|all)\s+{w.lower()}s?\b")) for i, w in enumerate(dt.WEEKDAYS)])
    limit = F.regexp_extract(low, r"\b(?:limit(?:ed)?\s+(?:to\s+)?|show me\s+|give me\s+|top\s+|first\s+)(\d{1,3})\b", 1).try_cast("int")
    return F.struct(
        F.when(everything, F.array().cast("array<string>")).otherwise(F.array_except(include, exclude)).alias("include_styles"), exclude.alias("exclude_styles"),
        F.array_except(types, no_types).alias("include_types"), no_types.alias("exclude_types"), days.alias("weekdays"), F.when(limit > 0, limit).alias("limit"),
    )


def term_variants(term: Column) -> Column:
    """A location term and its singular or plural form."""
    t = F.trim(F.regexp_replace(F.lower(term), r"\s+", " "))
    last = F.substring_index(t, " ", -1)
    head = F.substring(t, F.lit(1), F.length(t) - F.length(last))
    alt = (
        F.when(last.endswith("ies") & (F.length(last) > 4), F.concat(F.substring(last, F.lit(1), F.length(last) - 3), F.lit("y")))
        .when(last.endswith("s") & ~last.endswith("ss"), F.substring(last, F.lit(1), F.length(last) - 1))
        .when(last.endswith("y"), F.concat(F.substring(last, F.lit(1), F.length(last) - 1), F.lit("ies")))
        .otherwise(F.concat(last, F.lit("s")))
    )
    fixed = t.isin("victoria", "vancouver", "seattle") | (F.length(last) < 4)
    return F.when(fixed, F.array(t)).otherwise(F.array(t, F.concat(head, alt)))


def search_events(events: DataFrame, constraints: DataFrame, default_limit: int = 20) -> DataFrame:
    """Rows of each search, at most its limit, by date and time.

    ``constraints``: query_id, start_date, end_date (NULL for open), time_from, time_to,
    weekdays (Monday=0), include_styles, exclude_styles, include_types, exclude_types,
    locations, limit. Open ends are closed with the table's own first and last day, a
    search is spread over the months it covers, and months are joined by equality.
    """
    c = F.col
    bounds = events.agg(F.min("start_date").alias("_lo"), F.max("start_date").alias("_hi"))
    ranged = constraints.join(F.broadcast(bounds)).withColumns({
        "_from": F.greatest(F.coalesce("start_date", "_lo"), c("_lo")), "_to": F.least(F.coalesce("end_date", "_hi"), c("_hi")),
    }).filter("_from <= _to").drop("start_date", "end_date", "_lo", "_hi")
    spread = ranged.withColumn("_month", F.explode(F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))))

    def low(col):
        return F.lower(F.coalesce(c(col), F.lit("")))

    def some(arr, col):
        return (F.size(F.coalesce(c(arr), F.array().cast("array<string>"))) == 0) | F.exists(arr, lambda t: F.contains(low(col), F.lower(t)))

    def none(arr, col):
        # a NULL text satisfies neither LIKE nor NOT LIKE
        return F.forall(F.coalesce(c(arr), F.array().cast("array<string>")), lambda t: c(col).isNotNull() & ~F.contains(low(col), F.lower(t)))

    placed = F.exists("locations", lambda t: F.exists(term_variants(t), lambda v: (
        F.contains(low("location"), v) | F.contains(low("source"), v) | F.contains(low("url"), v))))
    keep = (
        c("start_date").between(c("_from"), c("_to"))
        & (c("time_from").isNull() | (c("start_sec") >= c("time_from"))) & (c("time_to").isNull() | (c("start_sec") <= c("time_to")))
        & ((F.size(F.coalesce("weekdays", F.array().cast("array<int>"))) == 0) | F.array_contains("weekdays", F.weekday("start_date")))
        & some("include_styles", "dance_style") & none("exclude_styles", "dance_style")
        & some("include_types", "event_type") & none("exclude_types", "event_type")
        & ((F.size(F.coalesce("locations", F.array().cast("array<string>"))) == 0) | placed)
    )
    met = events.withColumn("_month", F.trunc("start_date", "month")).join(spread, "_month").filter(keep)
    lim = F.coalesce("limit", F.lit(default_limit))
    hits = met.select("query_id", lim.alias("_lim"), *events.columns)
    return top_by_limit(hits, ["query_id"], c("_lim"), [F.asc("start_date"), F.asc("start_sec"), F.asc("event_id")], c("event_id")).drop("_lim")


def question_grid(templates: DataFrame) -> DataFrame:
    """All questions of each template: its placeholders filled with every combination of values.

    ``templates``: category, template, p1_name, p1_values, p2_name, p2_values (arrays; one
    parameter may be NULL). Values are exploded one after the other, so combinations
    stay rows of their template.
    """
    one = templates.withColumn("_v1", F.explode_outer("p1_values")).withColumn("_v2", F.explode_outer("p2_values"))

    def fill(text, name, value):
        slot = F.concat(F.lit("{"), F.col(name), F.lit("}"))
        return F.when(F.col(name).isNull() | F.col(value).isNull(), text).otherwise(F.replace(text, slot, F.col(value)))

    question = fill(fill(F.col("template"), "p1_name", "_v1"), "p2_name", "_v2")
    return one.select("category", question.alias("question"), F.col("_v1").alias("value_1"), F.col("_v2").alias("value_2"))
