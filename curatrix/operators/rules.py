"""Lists of patterns against texts, as joins by key that work at any size of either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u

WORD = r"[\p{L}\p{N}]+"
#: Characters of a needle without words that serve as its key.
SIGN_KEY = 4
#: Patterns that a text is searched for one by one; more are looked up by key.
FEW = 64
#: Joins texts into one; no pattern holds it.
BETWEEN = "\u0000"


def contained_in_text(docs: DataFrame, doc_key: str, body: str, needles: DataFrame, needle_key: str, needle: str, lower: bool = True) -> DataFrame:
    """(doc_key, needle_key) pairs where the document contains the needle literally.

    Each needle is looked up by one key: an inner word stands whole in any text that
    contains the needle, its first word ends a word of the text, its last word begins
    one, and a lone word lies inside one; a needle without words lies inside a stretch
    of signs and is keyed by its beginning. The words and stretches of a text are
    exploded into exactly the kinds and lengths that occur among the needles, which are
    looked up first, and joined by equality, so the work grows with the text, not with
    text times needles. Empty needles match nothing.
    """
    def fold(c):
        return F.lower(c) if lower else c

    n = needles.select(needle_key, fold(F.col(needle)).alias("_n")).filter("_n <> ''")
    inner = F.regexp_extract_all(F.regexp_replace("_n", r"^[\p{L}\p{N}]*|[\p{L}\p{N}]*$", ""), F.lit(WORD), F.lit(0))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    head, tail = F.regexp_extract("_n", rf"^({WORD})", 1), F.regexp_extract("_n", rf"({WORD})$", 1)
    use_tail = (tail != "") & ((head == "") | (F.length(tail) >= F.length(head)))

    def key(kind, text):
        return F.struct(F.lit(kind).alias("k"), text.alias("t"))

    chosen = (
        F.when(longest.isNotNull(), key("w", longest))
        .when((head != "") & (head == F.col("_n")), key("x", head))
        .when(use_tail, key("p", tail))
        .when(head != "", key("s", head))
        .otherwise(key("y", F.substring("_n", 1, SIGN_KEY)))
    )
    keyed = n.withColumn("_key", chosen)
    index = keyed.select(needle_key, "_n", F.concat_ws(":", "_key.k", "_key.t").alias("_w"), F.col("_key.k").alias("_kind"), F.length("_key.t").alias("_size"))
    # as many entries as there are kinds and word lengths
    found = index.select("_kind", F.when(F.col("_kind") != "w", F.col("_size")).alias("_size")).distinct().collect()
    shapes = sorted((r["_kind"], r["_size"]) for r in found if r["_kind"] != "w")
    kinds = {r["_kind"] for r in found}
    if not kinds:
        return docs.select(doc_key).join(needles.select(needle_key), F.lit(False))

    def keys_of(t, kind, size):
        end = F.length(t)

        def key_at(i):
            return F.concat(F.lit(f"{kind}:"), F.substring(t, i, F.lit(size)))

        if kind == "p":
            keys = F.array(key_at(F.lit(1)))
        elif kind == "s":
            keys = F.array(key_at(end - size + 1))
        else:
            keys = F.transform(F.sequence(F.lit(1), end - size + 1), key_at)
        fits = end >= size
        if "y" in kinds:
            fits = fits & (t.rlike(rf"^{WORD}$") == F.lit(kind != "y"))
        return F.when(fits, keys).otherwise(F.array().cast("array<string>"))

    d = docs.select(doc_key, fold(F.col(body)).alias("_b"))
    # stretches of signs are looked at only where a needle is one
    part = rf"{WORD}|[^\p{{L}}\p{{N}}]+" if "y" in kinds else WORD
    probes = d.select(doc_key, F.explode(F.array_distinct(F.regexp_extract_all("_b", F.lit(part), F.lit(0)))).alias("_token"))
    whole = F.concat(F.lit("w:"), "_token")
    if shapes:
        keys = [keys_of(F.col("_token"), k, s) for k, s in shapes]
        probes = probes.select(doc_key, F.explode(F.concat(*([F.array(whole)] if "w" in kinds else []), *keys)).alias("_w"))
    else:
        probes = probes.select(doc_key, whole.alias("_w"))
    met = probes.join(index.select(needle_key, "_n", "_w"), "_w").select(doc_key, needle_key, "_n").distinct()
    return met.join(d, doc_key).filter(F.contains("_b", "_n")).select(doc_key, needle_key)


def texts_with(texts, patterns: DataFrame, pattern: str) -> DataFrame:
    """(_t, pattern) of the distinct values of ``texts`` (one column ``_t``) that contain a pattern."""
    return contained_in_text(texts.filter("_t is not null").distinct(), "_t", "_t", patterns.select(pattern).distinct(), pattern, pattern, lower=False)


def anti_contains(df: DataFrame, needles: DataFrame, column: str = "url", needle: str = "domain") -> DataFrame:
    """Drop rows whose text contains any listed domain, in any case; rows without text stay."""
    low = F.lower(F.col(column))
    listed = texts_with(df.select(low.alias("_t")), needles.select(F.lower(F.trim(needle)).alias("_d")), "_d").select("_t").distinct()
    return df.join(listed, low == F.col("_t"), "left_anti")


def tag_by_keywords(df: DataFrame, keywords: DataFrame, evidence, out: str) -> DataFrame:
    """Set ``out`` to all keywords found in the evidence columns, with a changed flag.

    Up to ``FEW`` keywords are looked for in each row as it is read; more meet the texts by
    key, where a digest stands for the text.
    """
    body = F.concat_ws(BETWEEN, *[F.lower(tx.text(c)) for c in evidence])
    words = keywords.select(F.lower("keyword").alias("_k")).filter("_k <> ''").distinct()
    few = sorted(r["_k"] for r in words.limit(FEW + 1).collect())
    if len(few) <= FEW:
        listed = F.array(*[F.lit(k) for k in few]).cast("array<string>")
        tags = tx.let(body, lambda t: F.array_sort(F.filter(listed, lambda k: F.contains(t, k))))
        marked = df.withColumn("_found", tags)
        marked = marked.withColumn("_tags", F.when(F.size("_found") > 0, F.array_join("_found", ", "))).drop("_found")
    else:
        rows = df.withColumn("_h", F.sha2(body, 256))
        found = contained_in_text(rows.select("_h", body.alias("_t")), "_h", "_t", words, "_k", "_k", lower=False)
        tags = found.groupBy("_h").agg(F.array_join(F.array_sort(F.collect_set("_k")), ", ").alias("_tags"))
        marked = rows.join(tags, "_h", "left").select(*df.columns, "_tags")
    return marked.withColumns({"changed": F.col("_tags").isNotNull(), out: F.coalesce("_tags", F.col(out))}).drop("_tags")


def apply_overrides(df: DataFrame, rules: DataFrame, columns, url: str = "url") -> DataFrame:
    """Ordered rules set columns; a later rule wins.

    ``rules``: rule_order, match_kind (url_contains | url_equals | domain_equals), pattern,
    event_name_equals (NULL for any), set_column, set_value. Distinct urls meet the rules
    by key, each kind in its own join; the last value per column goes back to the rows.
    """
    keys = {"_u": F.lower(u.url_compare_key(url)), "_net": u.netloc(url), "_n": F.lower(tx.text("event_name"))}
    rows = df.withColumns(keys)
    distinct = rows.select(*keys).distinct()
    r = rules.select("rule_order", "match_kind", F.lower("pattern").alias("_p"), F.lower(F.trim("event_name_equals")).alias("_name"), "set_column", "set_value")
    part = r.filter("match_kind = 'url_contains'")
    inside = texts_with(distinct.select(F.col("_u").alias("_t")), part, "_p")
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    met = [
        distinct.join(inside, F.col("_u") == F.col("_t")).drop("_t").join(part, "_p"),
        distinct.join(r.filter("match_kind = 'url_equals'"), bare("_u") == bare("_p")),
        distinct.join(r.filter("match_kind = 'domain_equals'"), F.col("_net") == F.col("_p")),
    ]
    order = ["rule_order", "match_kind", "_p", "_name", "set_column", "set_value"]
    hits = met[0].unionByName(met[1]).unionByName(met[2]).filter("_name is null or _n = _name")
    last = [F.max_by("set_value", F.when(F.col("set_column") == c, F.struct(*order))).alias(f"_set_{c}") for c in columns]
    values = hits.groupBy(*[F.col(k).alias(f"_h{k}") for k in keys]).agg(*last)
    on = [F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in keys]
    joined = rows.join(values, on[0] & on[1] & on[2], "left")
    return joined.withColumns({c: F.coalesce(f"_set_{c}", F.col(c)) for c in columns}).drop(*keys, *[f"_h{k}" for k in keys], *[f"_set_{c}" for c in columns])


def alias_match(df: DataFrame, rules: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """First alias rule that fits a row: exact text first, then specific aliases inside the text.

    ``rules``: rule_order, rule_name, alias, source_equals, url_contains, address_id,
    street_number, postal_code. A rule whose street number or postal code contradicts
    the row is reported as skipped_conflict and not applied.
    """
    r = rules.select(tx.alias_text("alias").alias("_alias"), F.struct(
        "rule_order", tx.alias_text("alias").alias("alias"), "rule_name", F.lower(tx.text("source_equals")).alias("src"),
        F.lower(tx.text("url_contains")).alias("url"), "address_id", F.lower(tx.text("street_number")).alias("num"),
        F.upper(F.regexp_replace(tx.text("postal_code"), r"\s", "")).alias("post"),
    ).alias("r")).filter("_alias <> ''")
    have = set(df.columns)

    def get(c):
        return tx.text(c) if c in have else F.lit("")

    rows = df.withColumns({"_src": F.lower(get("source")), "_url": F.lower(get("url"))})
    said = rows.select(key, "_src", "_url", F.explode(F.array_distinct(F.array(*[tx.alias_text(t) for t in texts]))).alias("_t")).filter("_t <> ''")
    inside = texts_with(said.select("_t"), r.filter((F.length("_alias") >= 10) | F.contains("_alias", F.lit(" "))), "_alias")
    exact = said.join(r, F.col("_t") == F.col("_alias")).withColumn("exact", F.lit(True))
    part = said.join(inside, "_t").join(r, "_alias").withColumn("exact", F.lit(False))
    fits = ((F.col("r.src") == "") | (F.col("r.src") == F.col("_src"))) & ((F.col("r.url") == "") | F.contains("_url", F.col("r.url")))
    met = exact.unionByName(part).filter(fits).groupBy(key).agg(F.min(F.when(F.col("exact"), F.col("r"))).alias("_e"), F.min(F.when(~F.col("exact"), F.col("r"))).alias("_s"))
    hit = df.join(met, key).withColumn("_m", F.coalesce("_e", "_s"))
    num, post = F.lower(get("street_number")), F.upper(F.regexp_replace(get("postal_code"), r"\s", ""))
    conflict = ((num != "") & (F.col("_m.num") != "") & (num != F.col("_m.num"))) | ((post != "") & (F.col("_m.post") != "") & (post != F.col("_m.post")))
    return hit.select(
        key, F.col("_m.address_id").alias("address_id"), F.col("_m.rule_name").alias("rule_name"), F.col("_m.alias").alias("matched_alias"),
        F.when(F.col("_e").isNotNull(), "exact").otherwise("substring").alias("match_type"),
        F.when(conflict, "skipped_conflict").otherwise("applied").alias("decision"),
    )


def related_names(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """(a, b): distinct values of which one contains the other."""
    inside = contained_in_text(left, a, a, right, b, b, lower=False)
    around = contained_in_text(right, b, b, left, a, a, lower=False).select(a, b)
    return inside.unionByName(around).distinct()


def source_penalties(sources: DataFrame, penalties: DataFrame) -> DataFrame:
    """(_t, _penalty): sum of the penalties of the rules that a source equals or contains.

    ``sources`` has lower-cased names as ``_t``; ``penalties``: source_equals,
    source_contains, penalty. A rule counts once for a source.
    """
    rules = penalties.groupBy(F.lower(tx.text("source_equals")).alias("eq"), F.lower(tx.text("source_contains")).alias("has")).agg(F.sum(F.col("penalty").cast("double")).alias("w"))
    names = sources.filter("_t <> ''").distinct()
    equal = names.join(rules.filter("eq <> ''"), F.col("_t") == F.col("eq")).select("_t", "eq", "has", "w")
    part = texts_with(names, rules.filter("has <> ''"), "has").join(rules, "has").select("_t", "eq", "has", "w")
    return equal.unionByName(part).distinct().groupBy("_t").agg(F.sum("w").alias("_penalty"))
