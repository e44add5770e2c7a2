"""String column expressions shared by the operators. All JVM-side."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "no value" in the input feeds.
NULL_WORDS = ("null", "none", "nan", "", "n/a", "na", "nil", "undefined")
# Placeholders that do not name a source.
PLACEHOLDER_SOURCES = (
    "", "unknown", "unknown source", "none", "null", "n/a", "na", "source",
    "extracted text", "text extracted", "extracted_text",
)
# Words that carry no identity in a venue name.
VENUE_STOPWORDS = (
    "the", "and", "of", "in", "at", "on", "victoria", "bc", "canada", "ca", "venue", "club",
    "dance", "studio", "society", "association", "group", "hall", "center", "centre",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """Bind ``value`` once inside an expression, so that ``use`` does not re-evaluate it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def text(c: Column | str) -> Column:
    """Trimmed string, '' for NULL."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def blank(c: Column | str) -> Column:
    """True for NULL, '' and whitespace."""
    return text(c) == ""


def filled(c: Column | str) -> Column:
    """The trimmed value, or NULL when blank."""
    return F.when(~blank(c), text(c))


def squeeze(c: Column | str) -> Column:
    """Lower-cased text with runs of whitespace collapsed."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " "))


def null_words_to_null(c: Column | str) -> Column:
    return F.when(~F.lower(text(c)).isin(*NULL_WORDS), col(c))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """OR of literal substring tests; stays inside one codegen stage."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def alnum_only(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def alias_text(c: Column | str) -> Column:
    """Comparison form of a place name: '&' spelled out, punctuation to blanks."""
    spelled = F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def clean_keywords(c: Column | str) -> Column:
    """Strip braces and quotes, trim each comma-separated term, join with ', '."""
    bare = F.regexp_replace(text(c), r"""[\[\]{}'"]""", "")
    terms = F.filter(F.transform(F.split(bare, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.array_join(terms, ", ")


def specific_terms(arr: Column, vocabulary: Iterable[str], limit: int = 4) -> Column:
    """Known terms in first-seen order; '' when none or more than ``limit``."""
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    known = F.array_distinct(
        F.filter(F.transform(arr, lambda t: F.lower(F.trim(t))), lambda t: F.array_contains(vocab, t))
    )
    return F.when(F.size(known) <= limit, F.array_join(known, ", ")).otherwise("")


def evidence_terms(body: Column, vocabulary: Iterable[str]) -> Column:
    """Terms of the vocabulary that occur in ``body``, longest first; NULL when none."""
    ordered = sorted(set(vocabulary), key=lambda v: (-len(v), v))
    hits = F.filter(F.array(*[F.lit(v) for v in ordered]), lambda t: F.contains(body, t))
    return F.when(F.size(hits) > 0, F.array_join(hits, ", "))


def whole_word_terms(body: Column, terms: Iterable[str], default: str, ascii_words: bool = False) -> Column:
    """Terms that occur as whole words; the default term when there is none.

    With ``ascii_words`` only ASCII letters, digits and the underscore make words, so a term
    may stand beside any other letter.
    """
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))" if ascii_words else r"\b"
    hits = [
        F.when(F.lower(body).rlike(edge + _escape(t).replace(" ", r"\s+") + edge), F.lit(t))
        for t in terms
        if t and t != default
    ]
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(default)


def _escape(term: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in term)


def tag_set(c: Column | str) -> Column:
    """Order-free tag array: split on ',', '&' and '/', squeezed, sorted, distinct."""
    parts = F.split(F.lower(text(c)), "[,&/]")
    clean = F.transform(parts, lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t != "")))


def binary_label(c: Column | str, mode: str = "extract") -> Column:
    """0/1 label from messy text.

    ``extract`` takes the first lone 0 or 1; ``strict`` reads a number, maps -1 to 0
    and gives NULL for anything else (the caller treats NULL as invalid).
    """
    if mode == "extract":
        return F.when(
            col(c).cast("string").rlike(r"(?<!\d)[01](?!\d)"),
            F.regexp_extract(col(c).cast("string"), r"(?<!\d)([01])(?!\d)", 1).cast("int"),
        )
    number = text(c).try_cast("double")
    return F.when(number == -1, 0).when(number.isin(0, 1), number.cast("int"))


def venue_tokens(c: Column | str) -> Column:
    """Distinguishing tokens of a venue name (3+ characters, no stop words)."""
    stop = F.array(*[F.lit(w) for w in VENUE_STOPWORDS])
    tokens = F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(
        F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))
    )


def token_overlap(a: Column, b: Column) -> Column:
    """Shared venue token; a side without tokens does not rule a pair out."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def is_placeholder_source(c: Column | str) -> Column:
    low = F.lower(text(c))
    return low.isin(*PLACEHOLDER_SOURCES) | low.contains("extracted text")


def snippet(c: Column | str, needle: str, n: int) -> Column:
    """Window of ``n`` characters around the first ``needle``; NULL when absent."""
    pos = F.locate(needle, col(c))
    start = F.greatest(pos - n, F.lit(1))
    return F.when(pos > 0, F.substring(col(c), start, pos + len(needle) + n - start))


def text_segment(c: Column | str, start: str, end: str, fallback: int) -> Column:
    """Text from ``start`` up to the next ``end`` marker, else ``fallback`` characters."""
    body = col(c)
    s = F.locate(start, body)
    tail = F.substring(body, s, F.length(body))
    e = F.locate(end, F.substring(tail, F.lit(len(start) + 1), F.length(tail)))
    cut = F.when(e > 0, F.lit(len(start)) + e - 1).otherwise(F.lit(fallback))
    return F.when(s > 0, F.substring(tail, F.lit(1), cut)).otherwise(F.substring(body, F.lit(1), F.lit(fallback)))


def low_quality_location(c: Column | str) -> Column:
    """Location text too poor to identify a place."""
    t = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return (
        (t == "")
        | t.rlike(r"^[A-Z]{2,6},\s*CA$")
        | F.lower(t).isin("ca", "canada", "bc", "victoria", "vancouver")
    )


def low_quality_name(c: Column | str) -> Column:
    """Building name too short, or only an upper-case abbreviation."""
    t = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return (F.length(t) < 6) | t.rlike("^[A-Z]{2,6}$")
