"""URL keys as column expressions. Parts come from one total pattern, so bad URLs give '' parts, never errors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alnum_only, col, is_placeholder_source, let, text

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"

# Cache parameters of image hosts that do not change the image.
CDN_CACHE_PARAMS = ("_nc_gid", "_nc_ohc", "_nc_oc", "oh", "oe", "_nc_zt", "_nc_ad", "_nc_cid", "ccb")
# Page sections that never list events.
LOW_VALUE_SEGMENTS = (
    "about", "contact", "faculty", "faq", "staff", "student-wellness", "team",
    "vocational-division", "open-division", "international-waitlist",
)


def part(c: Column | str, n: int) -> Column:
    return F.regexp_extract(text(c), PARTS, n)


def scheme(c):
    return F.lower(part(c, 1))


def netloc(c):
    return F.lower(part(c, 2))


def path(c):
    return part(c, 3)


def query(c):
    return part(c, 4)


def fragment(c):
    return part(c, 5)


def host(c):
    """Lower-case host without port."""
    return F.regexp_replace(netloc(c), ":[0-9]*$", "")


def _with(prefix: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(prefix), c)).otherwise("")


def _default_scheme(c) -> Column:
    return F.when(scheme(c) == "", "https").otherwise(scheme(c))


def _rooted(p: Column) -> Column:
    return F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)


def _trim_slash(p: Column) -> Column:
    return F.regexp_replace(p, "/+$", "")


def url_compare_key(c: Column | str) -> Column:
    """Comparison form: default ports, trailing '/' and fragment removed, query kept."""
    net = F.when(_default_scheme(c) == "http", F.regexp_replace(netloc(c), ":80$", "")).otherwise(
        F.regexp_replace(netloc(c), ":443$", "")
    )
    return F.concat(_default_scheme(c), F.lit("://"), net, _rooted(_trim_slash(path(c))), _with("?", query(c)))


def url_eval_key(c: Column | str, keep_image_fragment: bool = False) -> Column:
    """Evaluation-split key; bare mail addresses are lower-cased whole."""
    t = text(c)
    frag = _with("#", F.when(fragment(c).startswith("image="), fragment(c)).otherwise("")) if keep_image_fragment else F.lit("")
    url = F.concat(
        _default_scheme(c), F.lit("://"), netloc(c), _rooted(_trim_slash(path(c))), _with("?", query(c)), frag
    )
    mail = ~t.contains("://") & t.contains("@") & ~t.contains("/") & ~t.contains("?")
    return F.when(t == "", "").when(mail, F.lower(t)).otherwise(url)


def strip_params(c: Column | str, names: Iterable[str], applies: Column | None = None) -> Column:
    """Remove the named query parameters, keeping the others in order, where ``applies``."""
    drop = F.array(*[F.lit(n) for n in names])
    kept = F.array_join(
        F.filter(
            F.split(query(c), "&"),
            lambda p: (p != "") & ~F.array_contains(drop, F.substring_index(p, "=", 1)),
        ),
        "&",
    )
    base = F.regexp_replace(text(c), r"[?#][\s\S]*$", "")
    out = F.concat(base, _with("?", kept), _with("#", fragment(c)))
    return out if applies is None else F.when(applies, out).otherwise(col(c))


def is_image_cdn(c: Column | str) -> Column:
    h = netloc(c)
    return (
        h.contains("instagram.com") | h.contains("scontent.cdninstagram.com")
        | (h.contains("fbcdn.net") & (h.contains("instagram") | h.contains("scontent")))
    )


def strip_cdn_params(c: Column | str) -> Column:
    return strip_params(c, CDN_CACHE_PARAMS, is_image_cdn(c))


def path_segments(c: Column | str) -> Column:
    return F.filter(F.split(path(c), "/"), lambda s: s != "")


def url_template_key(c: Column | str, families: Iterable[tuple[str, str, str]] = ()) -> Column:
    """Collapse templated detail URLs to their family.

    ``families`` are extra (host substring, path pattern, family path) rules tried
    before the generic event rules, so that single items do not become features.
    """
    seg = path_segments(c)
    s0, s1 = F.lower(F.get(seg, F.lit(0))), F.lower(F.get(seg, F.lit(1)))
    base = F.concat(_default_scheme(c), F.lit("://"), netloc(c))
    out = F.when(text(c) == "", "")
    for host_part, pattern, family in families:
        out = out.when(
            netloc(c).contains(host_part) & F.lower(path(c)).rlike(pattern),
            F.concat(base, F.regexp_replace(F.regexp_extract(F.lower(path(c)), pattern, 0), pattern, family)),
        )
    return (
        out.when((F.size(seg) >= 2) & (s0 == "event"), F.concat(base, F.lit("/event/"), s1))
        .when(s0 == "events", F.concat(base, F.lit("/events")))
        .when(F.lower(query(c)).contains("event"), F.concat(base, path(c)))
        .otherwise(text(c))
    )


# URL families of the big platforms (host, path pattern, family path).
PLATFORM_FAMILIES = (
    ("facebook.com", "^/events(/.*)?$", "/events"),
    ("facebook.com", "^/([^/]+)/posts/.+$", "/$1/posts"),
    ("instagram.com", "^/(p|reel|tv)(/.*)?$", "/$1"),
    ("eventbrite", "^/(e|o)(/.*)?$", "/$1"),
    ("google.", "^/calendar/event(/.*)?$", "/calendar/event"),
    ("calendar.google.com", "^/calendar(/.*)?$", "/calendar"),
)


def url_variants(c: Column | str) -> Column:
    """Distinct spellings of one page: scheme, trailing slash, without query or fragment."""
    p = path(c)
    bare = F.when(p.endswith("/") & (p != "/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    sc, net = part(c, 1), part(c, 2)
    other = F.when(F.lower(sc) == "https", "http").when(F.lower(sc) == "http", "https").otherwise(sc)

    def make(s, pth):
        return F.concat(s, F.lit("://"), net, pth)

    slashed = F.when((bare != "") & ~bare.endswith("/"), F.concat(bare, F.lit("/"))).otherwise(bare)
    flipped_own = F.when(
        (p != "") & (p != "/"),
        F.when(p.endswith("/"), F.concat(sc, F.lit("://"), net, _trim_slash(p), _with("?", query(c)), _with("#", fragment(c))))
        .otherwise(F.concat(sc, F.lit("://"), net, p, F.lit("/"), _with("?", query(c)), _with("#", fragment(c)))),
    ).otherwise(text(c))
    return F.array_distinct(
        F.array(
            text(c), make(sc, bare), make(sc, slashed), make(other, bare),
            F.when((bare != "") & (bare != "/"), make(other, slashed)).otherwise(make(other, bare)),
            flipped_own,
        )
    )


def url_identity(c: Column | str) -> Column:
    """scheme://host/path, lower-cased; other text lower-cased without trailing '/'."""
    ok = (scheme(c) != "") & (host(c) != "")
    return F.when(
        ok, F.concat(scheme(c), F.lit("://"), host(c), F.lower(_trim_slash(path(c))))
    ).otherwise(F.lower(F.regexp_replace(text(c), "/+$", "")))


def unwrap_next(c: Column | str, host_part: str, depth: int = 3) -> Column:
    """Follow up to ``depth`` nested ``next=`` redirects of login pages on one platform."""
    def hop(cur):
        nxt = F.trim(F.try_url_decode(F.regexp_extract(query(cur), r"(?:^|&)next=([^&]*)", 1)))
        absolute = F.when(nxt.startswith("/"), F.concat(F.lit(f"https://www.{host_part}"), nxt)).otherwise(nxt)
        login = netloc(cur).contains(host_part) & F.lower(path(cur)).rlike("/login|/recover/initiate")
        return F.when(login & (F.coalesce(nxt, F.lit("")) != ""), absolute).otherwise(cur)

    out = text(c)
    for _ in range(depth):
        out = let(out, hop)
    return out


def source_from_url(c: Column | str) -> Column:
    """Second-level host label ('' without a host)."""
    h = F.regexp_replace(F.regexp_replace(netloc(c), r"^www\.", ""), ":[\\s\\S]*$", "")
    labels = F.filter(F.split(h, r"\."), lambda s: s != "")
    n = F.size(labels)
    return F.coalesce(F.when(n >= 2, F.get(labels, n - 2)).otherwise(F.get(labels, F.lit(0))), F.lit(""))


def source_matches_url(source: Column | str, url: Column | str) -> Column:
    """Source label and host label contain each other (letters and digits only)."""
    s, u = alnum_only(source), alnum_only(source_from_url(url))
    return (s != "") & (u != "") & (F.contains(s, u) | F.contains(u, s))


def resolve_source(source, url, parent_url) -> Column:
    own, par = source_from_url(url), source_from_url(parent_url)
    return (
        F.when(~is_placeholder_source(source), text(source))
        .when(own != "", own)
        .when(par != "", par)
        .otherwise("unknown")
    )


def looks_http(c: Column | str) -> Column:
    return F.lower(text(c)).rlike("^https?://")


def effective_url(*candidates: Column | str) -> Column:
    """First http(s) URL among the candidates, else ''."""
    return F.coalesce(*[F.when(looks_http(c), text(c)) for c in candidates], F.lit(""))


def low_value_path(c: Column | str, segments: Iterable[str] = LOW_VALUE_SEGMENTS) -> Column:
    return F.arrays_overlap(
        F.transform(path_segments(c), F.lower), F.array(*[F.lit(s) for s in segments])
    )


def url_date(c: Column | str) -> Column:
    """Date written in a URL path: /2024-05-01/ or a compact 07mar24 token."""
    low = F.lower(text(c))
    iso = F.regexp_extract(low, r"/(20\d{2}-\d{2}-\d{2})(?:/|$|[?#])", 1)
    compact = r"(?:^|[^0-9])(\d{1,2})(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(\d{2})(?:[^0-9]|$)"
    from .dates import month_number, try_make_date

    alt = try_make_date(
        F.concat(F.lit("20"), F.regexp_extract(low, compact, 3)),
        month_number(F.regexp_extract(low, compact, 2)),
        F.regexp_extract(low, compact, 1),
    )
    return F.coalesce(F.when(iso != "", iso.try_cast("date")), alt)


def detail_url_kind(c: Column | str, kinds: Iterable[tuple[str, str, str]]) -> Column:
    """Struct (kind, candidates): the first (kind, host pattern, path pattern) that fits.

    Candidates are the URL, its query-free form and that form without trailing '/'.
    """
    kind = F.lit(None).cast("string")
    for name, host_pattern, path_pattern in reversed(list(kinds)):
        kind = F.when(netloc(c).rlike(host_pattern) & path(c).rlike(path_pattern), F.lit(name)).otherwise(kind)
    bare = F.concat(_default_scheme(c), F.lit("://"), part(c, 2), path(c))
    cands = F.array_distinct(F.array(text(c), bare, F.regexp_replace(bare, "/+$", "")))
    return F.struct(
        kind.alias("kind"), F.when(kind.isNotNull(), cands).otherwise(F.array().cast("array<string>")).alias("candidates")
    )


# Static event pages of the big platforms (kind, host pattern, path pattern).
STATIC_DETAIL_KINDS = (
    ("facebook_event_detail", r"facebook\.com", r"/events/\d+"),
    ("eventbrite_event_detail", r"eventbrite\.", r"-tickets-\d+"),
    ("instagram_post_detail", r"instagram\.com", r"^/(p|reel|tv)/[^/]+"),
)


def calendar_ids(c: Column | str) -> Column:
    """Calendar ids in a URL: plain ids after decoding twice, else the base64 ``src``/``cid`` value."""
    once = F.coalesce(F.try_url_decode(text(c)), text(c))
    twice = F.coalesce(F.try_url_decode(once), once)
    plain = F.array_distinct(
        F.regexp_extract_all(twice, F.lit(r"([A-Za-z0-9_.+-]+@(?:group\.calendar\.google\.com|gmail\.com))"), F.lit(1))
    )
    raw = F.regexp_extract(once, r"[?&](?:src|cid)=([A-Za-z0-9_=-]+)", 1)
    std = F.translate(raw, "-_", "+/")
    padded = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    valid = decoded.rlike(r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
    return F.when(F.size(plain) > 0, plain).when(valid, F.array(decoded)).otherwise(F.array().cast("array<string>"))


# Slug words of dance events and of other events.
RELEVANT_SLUGS = (
    "dance", "salsa", "bachata", "kizomba", "zou", "swing", "lindy", "ballroom", "west coast", "wcs", "tango",
    "milonga", "latin", "social dance", "rueda", "blues dance", "contra dance",
)
IRRELEVANT_SLUGS = (
    "comedy", "standup", "startup", "business", "networking", "tech", "coding", "hackathon", "crypto", "real estate",
    "church service", "worship", "politics", "seminar", "conference",
)


def url_relevance(c: Column | str, positive: Iterable[str] = RELEVANT_SLUGS, negative: Iterable[str] = IRRELEVANT_SLUGS) -> Column:
    """true / false / NULL (unknown) from tokens in path and query."""
    slug = F.translate(F.lower(F.concat(path(c), F.lit(" "), query(c))), "-_", "  ")
    from .text import contains_any

    return F.when(contains_any(slug, positive), True).when(contains_any(slug, negative), False)


def without_dots(path: Column) -> Column:
    """Path without ``.`` and ``..`` segments; ``..`` at the root stays at the root."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    closed = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        closed, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.least(F.size(acc), F.lit(1))))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def url_join(page: Column, link: Column) -> Column:
    """Absolute form of a link found on a page: own scheme, other host, root path, query, fragment or path beside the page."""
    link = F.trim(link)
    bare = F.regexp_extract(page, r"^([^?#]*)", 1)
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.substring(bare, F.length(root) + 1, F.length(bare)), "[^/]*$", "")
    path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    beside = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
    return (
        F.when(link == "", page)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(page, r"^([^:]*:)", 1), link))
        .when(link.startswith("/"), F.concat(root, without_dots(path), rest))
        .when(link.startswith("?"), F.concat(bare, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), link))
        .otherwise(F.concat(root, without_dots(beside), rest))
    )
