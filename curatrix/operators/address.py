"""Resolving location text against the address table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy as fz
from ..functions import text as tx
from ..session import cut_lineage, written
from .keyed import global_rank, spread
from .normalize import STREET_TYPES, build_full_address
from .rules import contained_in_text


def match_street(df: DataFrame, addr: DataFrame, key: str, location: str) -> DataFrame:
    """Address whose street number is the first number in the text and whose street name occurs in it (lowest id)."""
    rows = df.select(key, F.col(location).alias("_loc"))
    probe = rows.select("_loc", F.regexp_extract("_loc", r"(\d+)", 1).alias("_num")).filter("_num <> ''").distinct()
    named = addr.filter(~tx.blank("street_name"))
    inside = contained_in_text(probe.select("_loc"), "_loc", "_loc", named.select("street_name").distinct(), "street_name", "street_name", lower=False)
    first = named.groupBy(F.col("street_number").alias("_num"), "street_name").agg(F.min("address_id").alias("address_id"))
    found = probe.join(inside, "_loc").join(first, ["_num", "street_name"]).groupBy("_loc").agg(F.min("address_id").alias("address_id"))
    return rows.join(found, "_loc").groupBy(key).agg(F.min("address_id").alias("address_id"))


def name_tokens(c: Column | str) -> Column:
    """Join keys of a venue name: its distinguishing tokens."""
    return F.transform(tx.venue_tokens(c), lambda t: t)


def piece_pairs(left: DataFrame, right: DataFrame, a: str, b: str, percent: float) -> DataFrame:
    """(a, b): pairs of texts that ``floor(m * percent / 100)`` insertions and deletions may tell apart.

    ``m`` is the length of the shorter text, which may also stand within the longer one.
    The shorter text is cut into one piece more than these edits, so one of them is left
    unchanged in the longer text; pieces meet substrings of their lengths by equality. A
    pair is given by the first piece the longer text holds, hence once, without a shuffle
    of pairs. Distinct texts are expected on both sides.
    """
    percent = max(percent, 10.0)
    sizes = F.array(*[F.lit(n) for n in range(1, math.ceil(100 / percent) + 1)])

    def cut(df, x):
        m = F.length(x)
        # never 0, also for an empty text, whose plan may be evaluated before it is filtered away
        k = F.greatest(F.lit(1), F.least(m, F.floor(m * percent / 100).cast("int") + 1))
        at = F.transform(F.sequence(F.lit(0), k), lambda i: F.floor(i * m / k).cast("int"))
        pieces = F.transform(F.sequence(F.lit(1), k), lambda i: F.substring(x, F.get(at, i - 1) + 1, F.get(at, i) - F.get(at, i - 1)))
        whole = df.filter(m > 0).select(x, F.array_distinct(pieces).alias("_all"))
        return whole.select(x, "_all", F.posexplode("_all").alias("_i", "_piece"))

    def inside(df, x):
        m = F.length(x)
        starts = F.sequence(F.lit(1), m)
        grams = F.flatten(F.transform(sizes, lambda n: F.transform(F.filter(starts, lambda i: i <= m - n + 1), lambda i: F.substring(x, i, n))))
        return df.filter(m > 0).select(x, F.explode(F.array_distinct(grams)).alias("_piece"))

    def met(short, long, x, y, shorter):
        pairs = cut(short, x).join(inside(long, y), "_piece").filter(shorter)
        first = ~F.exists(F.slice("_all", F.lit(1), F.col("_i")), lambda p: F.contains(F.col(y), p))
        return pairs.filter(first).select(a, b)

    return met(left, right, a, b, F.length(a) <= F.length(b)).unionByName(met(right, left, b, a, F.length(b) < F.length(a)))


def close_pairs(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """(a, b): distinct texts whose partial ratio can reach the threshold; a window is no longer than the shorter text.

    Of equal lengths each text is a window of the other, and both have the same bound.
    """
    return piece_pairs(left, right, a, b, 200 - 2 * threshold)


def scored_names(left: DataFrame, right: DataFrame, scores: Callable = fz.name_scores, lower: bool = False, partial: float | None = None) -> DataFrame:
    """(left_name, right_name, s): scores of the distinct pairs of names that can matter.

    With ``partial`` these are all names whose partial score can reach that threshold.
    Else a pair must share a distinguishing token, unless a name has no such token: that
    one meets every name whose ratio can reach 75 or whose token-set score can reach 85.
    Both sides are reduced to distinct names first, so repeated names cost one comparison.
    """
    def side(df, out):
        return df.select(F.col("name").alias(out)).filter(~tx.blank(out)).distinct()

    x, y = side(left, "left_name"), side(right, "right_name")
    if partial is not None:
        def forms(df, c):
            return df.select((F.lower(c) if lower else F.col(c)).alias(f"_{c}")).distinct()

        met = close_pairs(forms(x, "left_name"), forms(y, "right_name"), "_left_name", "_right_name", partial)
        u, v = F.col("_left_name"), F.col("_right_name")
        scored = met.withColumn("s", scores(u, v)).filter(F.col("s.partial") >= partial)
        own = [(F.lower(c) if lower else F.col(c)) == F.col(f"_{c}") for c in ("left_name", "right_name")]
        return scored.join(x, own[0]).join(y, own[1]).select("left_name", "right_name", "s")

    def by_token(df, c):
        return df.select(c, F.explode(name_tokens(c)).alias("_t"))

    def bare(df, c):
        return df.filter(F.size(tx.venue_tokens(c)) == 0)

    x, y = cut_lineage(x), cut_lineage(y)  # read five times each
    met = by_token(x, "left_name").join(by_token(y, "right_name"), "_t").select("left_name", "right_name")
    for l, r, few in ((bare(x, "left_name"), y, 0), (x, bare(y, "right_name"), 1)):
        # the other side's names are cut into pieces only where some name has no token
        if not (l, r)[few].isEmpty():
            met = met.unionByName(_near_names(l, r, lower))
    pairs = spread(met, "left_name", "right_name").distinct()
    a, b = F.col("left_name"), F.col("right_name")
    return pairs.withColumn("s", scores(F.lower(a), F.lower(b)) if lower else scores(a, b))


def _near_names(left: DataFrame, right: DataFrame, lower: bool) -> DataFrame:
    """(left_name, right_name): pairs that share a word, or whose ratio as written can reach 75, or with sorted words 85."""
    names = ("left_name", "right_name")

    def fold(c):
        return F.lower(c) if lower else F.col(c)

    def words(c):
        return F.array_sort(F.array_distinct(F.filter(F.split(fold(c), r"\s+"), lambda w: w != "")))

    def forms(df, c, form):
        return df.select(c, form(c).alias(f"_{c}"))

    out = left.select("left_name", F.explode(words("left_name")).alias("_w")).join(right.select("right_name", F.explode(words("right_name")).alias("_w")), "_w").select(*names)
    # a ratio of t allows 2 * (100 - t) / t edits for each sign of the shorter text
    for form, percent in ((fold, 20000 / 75 - 200), (lambda c: F.array_join(words(c), " "), 20000 / 85 - 200)):
        x, y = forms(left, "left_name", form), forms(right, "right_name", form)
        met = piece_pairs(x.select("_left_name").distinct(), y.select("_right_name").distinct(), "_left_name", "_right_name", percent + 1e-6)
        out = out.unionByName(met.join(x, "_left_name").join(y, "_right_name").select(*names))
    return out


def resolve_address(parsed: DataFrame, addr: DataFrame, key: str, scores: Callable = fz.name_scores, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matched, inserts): each parsed address gets the first tier that finds an existing row.

    Tiers: alias rule; postal code and number; number and street; city and name; name
    alone; name inside a name. Within a tier the lowest address_id wins. Candidates come
    from equi-joins on the tier's keys and from one scored table of distinct name pairs.
    ``inserts`` holds the distinct full addresses of the rest with new ids.
    """
    c = F.col
    p = parsed.select(
        key, *[tx.text(x).alias(x) if x in parsed.columns else F.lit("").alias(x)
               for x in ("building_name", "street_number", "street_name", "street_type", "direction", "city", "province_or_state", "postal_code", "country_id")]
    )
    a = addr.select(
        F.col("address_id"), *[tx.text(x).alias(f"a_{x}") if x in addr.columns else F.lit("").alias(f"a_{x}") for x in ("building_name", "street_number", "street_name", "city", "postal_code")]
    )
    sim = scored_names(p.select(c("building_name").alias("name")), a.select(c("a_building_name").alias("name")), scores)
    # five tiers read the scores; written once so that the UDF does not run per tier
    sim = cut_lineage(sim.select("left_name", "right_name", "s.*"))

    def keyed_tier(tier, fields, ratio, partial, token):
        # rows of one key and name stand for each other, so the pairs are those of distinct names
        keys = [f"_{f}" for f in fields]
        probe = p.filter(" and ".join(f"{f} <> ''" for f in fields)).select(key, "building_name", *[F.lower(f).alias(f"_{f}") for f in fields])
        have = a.groupBy(*[F.lower(f"a_{f}").alias(f"_{f}") for f in fields], "a_building_name").agg(F.min("address_id").alias("address_id"), F.count(F.lit(1)).alias("_n"))
        close = sim.filter((c("ratio") >= ratio) | (c("partial") >= partial) | (c("token_set") >= token)).select("left_name", "right_name")
        asked = probe.filter("building_name <> ''").select("building_name", *keys).distinct()
        near = asked.join(close, c("building_name") == c("left_name")).join(have.withColumnRenamed("a_building_name", "right_name"), ["right_name", *keys])
        found = near.groupBy("building_name", *keys).agg(F.min("address_id").alias("address_id"))
        named = probe.join(found, ["building_name", *keys]).select(key, "address_id")
        # the number of rows that a key's rows meet
        single = probe.join(have.groupBy(*keys).agg(F.sum("_n").alias("_n")), keys).groupBy(key).agg(F.sum("_n").alias("_n")).filter("_n = 1")
        bare = probe.filter("building_name = ''").join(have.filter("a_building_name = ''").drop("_n"), keys).join(single, key).select(key, "address_id")
        return best(named.unionByName(bare), tier)

    def best(df, tier):
        return df.groupBy(key).agg(F.min("address_id").alias("address_id")).withColumn("tier", F.lit(tier))

    t1 = keyed_tier(2, ("postal_code", "street_number"), 85, 95, 90)
    t2 = keyed_tier(3, ("street_number", "street_name"), 75, 90, 85)
    by_name = a.filter("a_building_name <> ''").groupBy(c("a_building_name").alias("right_name")).agg(F.min("address_id").alias("address_id"))
    by_city = a.filter("a_building_name <> '' and a_city <> ''").groupBy(c("a_building_name").alias("right_name"), F.lower("a_city").alias("_city")).agg(F.min("address_id").alias("address_id"))
    named = p.filter("building_name <> ''").select(key, c("building_name").alias("left_name"), F.lower("city").alias("_city"))

    strong = sim.filter((c("ratio") >= 90) | (c("partial") >= 95) | (c("token_set") >= 95))
    in_city = named.filter("_city <> ''").select("left_name", "_city").distinct().join(strong, "left_name").join(by_city, ["right_name", "_city"])
    t3 = best(named.join(in_city.groupBy("left_name", "_city").agg(F.min("address_id").alias("address_id")), ["left_name", "_city"]), 4)
    sure = sim.filter((c("ratio") >= 95) | ((c("partial") >= 98) & (c("token_set") >= 95)))
    t4 = best(named.join(sure.join(by_name, "right_name").groupBy("left_name").agg(F.min("address_id").alias("address_id")), "left_name"), 5)
    inside = sim.filter((c("partial") >= 80) & (F.length("left_name") > 2)).join(by_name, "right_name").groupBy("left_name").agg(
        F.max_by("address_id", F.struct("partial", -c("address_id"))).alias("address_id"))
    t5 = named.join(inside, "left_name").select(key, "address_id", F.lit(6).alias("tier"))
    tiers = [t1, t2, t3, t4, t5]
    if aliases is not None:
        tiers.insert(0, aliases.filter("decision = 'applied'").select(key, "address_id", F.lit(1).alias("tier")))
    hits = tiers[0]
    for t in tiers[1:]:
        hits = hits.unionByName(t)
    matched = hits.groupBy(key).agg(F.min_by(F.struct("address_id", "tier"), F.struct("tier", "address_id")).alias("m")).select(key, "m.address_id", "m.tier")
    rest = p.join(matched, key, "left_anti")
    rest = rest.withColumn("full_address", build_full_address(rest)).filter(~tx.blank("full_address"))
    one = rest.groupBy("full_address").agg(F.min(F.struct(*[x for x in rest.columns if x not in ("full_address", key)])).alias("r"))
    top = addr.agg(F.coalesce(F.max("address_id"), F.lit(0)).alias("_top"))
    ranked = global_rank(one, ["full_address"], "_rank")
    inserts = ranked.join(F.broadcast(top)).select((c("_top") + c("_rank")).alias("address_id"), "full_address", "r.*")
    return matched, inserts


def quick_lookup(df: DataFrame, addr: DataFrame, key: str, location: str, scores: Callable = fz.name_scores, ratio: Callable = fz.indel_ratio) -> DataFrame:
    """(key, address_id, step): exact text, single street match, best name on the street, best name, near-equal text.

    Each step looks only at the distinct texts that the steps before it left over. Names
    on a street meet by a shared token; only names without any meet all names there.
    """
    c = F.col
    rows = df.select(key, tx.text(location).alias("_loc")).filter("_loc <> ''")
    a = addr.select("address_id", tx.text("building_name").alias("_b"), (tx.text("full_address") if "full_address" in addr.columns else F.lit("")).alias("_f"), F.lower(tx.text("street_number")).alias("_n"), F.lower(tx.text("street_name")).alias("_s"))
    full = a.filter("_f <> ''").groupBy(F.lower("_f").alias("_lf")).agg(F.min("address_id").alias("address_id"))
    texts = rows.select("_loc").distinct().join(full, F.lower("_loc") == c("_lf"), "left").select("_loc", "address_id")
    texts = cut_lineage(texts)
    exact = texts.filter("address_id is not null").select("_loc", "address_id", F.lit(1).alias("step"))
    street = rf"(?i)(\d+)\s+([A-Za-z\s]+?)(?:,|\s+(?:{STREET_TYPES}))"
    parsed = texts.filter("address_id is null").select("_loc").withColumns({
        "_num": F.regexp_extract("_loc", street, 1),
        "_str": F.lower(F.trim(F.regexp_replace(F.regexp_extract("_loc", street, 2), rf"(?i)\b(?:{STREET_TYPES})\b", ""))),
        "_bld": F.trim(F.regexp_extract("_loc", r"^([^,\d]+?)(?:,|\s+\d+)", 1)),
    })
    line = (c("_num") == c("_n")) & (c("_str") == c("_s"))
    lines = a.groupBy("_n", "_s").agg(F.count(F.lit(1)).alias("_k"), F.min("address_id").alias("address_id"))
    counted = parsed.filter("_num <> ''").join(lines, line)
    single = counted.filter("_k = 1").select("_loc", "address_id", F.lit(2).alias("step"))
    no_token = lambda c: F.size(tx.venue_tokens(c)) == 0
    asked = cut_lineage(counted.filter("_k > 1 and _bld <> ''").select(F.lower("_bld").alias("_bld"), "_n", "_s").distinct())
    names = a.filter("_b <> '' and _n <> ''").select(F.lower("_b").alias("_b"), "_n", "_s").distinct()
    by_token = asked.withColumn("_t", F.explode(name_tokens("_bld"))).join(names.withColumn("_t", F.explode(name_tokens("_b"))), ["_n", "_s", "_t"]).drop("_t")
    bare = asked.join(names.filter(no_token("_b")), ["_n", "_s"]).unionByName(asked.filter(no_token("_bld")).join(names, ["_n", "_s"]))
    several = spread(by_token.unionByName(bare), "_bld", "_b").distinct().withColumn("_r", ratio(c("_bld"), c("_b"))).filter("_r >= 85")
    ids = a.groupBy("_n", "_s", F.lower("_b").alias("_b")).agg(F.min("address_id").alias("address_id"))
    best = several.join(ids, ["_n", "_s", "_b"]).groupBy("_bld", "_n", "_s").agg(F.max_by("address_id", F.struct("_r", -c("address_id"))).alias("address_id"))
    named = parsed.withColumns({"_n": c("_num"), "_s": c("_str"), "_bld": F.lower("_bld")}).join(best, ["_bld", "_n", "_s"]).select("_loc", "address_id", F.lit(3).alias("step"))
    free = parsed.filter("_num = ''").select(c("_loc").alias("left_name"))
    sim = scored_names(free.select(c("left_name").alias("name")), a.select(c("_b").alias("name")), scores, lower=True)
    sim = sim.withColumn("_r", F.greatest("s.ratio", "s.partial")).filter("_r >= 80")
    by_name = a.filter("_b <> ''").groupBy(c("_b").alias("right_name")).agg(F.min("address_id").alias("address_id"))
    best = sim.join(by_name, "right_name").groupBy("left_name").agg(F.max_by("address_id", F.struct("_r", -c("address_id"))).alias("address_id"))
    by_text = best.select(c("left_name").alias("_loc"), "address_id", F.lit(4).alias("step"))
    # read three times below; written once, so that the plan stays small
    hits = cut_lineage(exact.unionByName(single).unionByName(named).unionByName(by_text))
    # near-equal text: shared token of the building name; without such tokens on a side any text that can reach 90
    rest = cut_lineage(texts.select("_loc").join(hits, "_loc", "left_anti"))
    full = a.filter("_f <> ''")
    probe = rest.select("_loc", F.explode(name_tokens("_loc")).alias("_t"))
    index = full.select("_f", F.explode(name_tokens("_b")).alias("_t")).distinct()
    close = F.least(F.length("_loc"), F.length("_f")) * 200 >= 90 * (F.length("_loc") + F.length("_f"))
    near = probe.join(index, "_t").filter(close).select("_loc", "_f")
    for x, y, few in ((rest.filter(no_token("_loc")), full, 0), (rest, full.filter(no_token("_b")), 1)):
        if (x, y)[few].isEmpty():
            continue
        said, fulls = (t.select(c, F.lower(c).alias(n)).distinct() for t, c, n in ((x, "_loc", "_ll"), (y, "_f", "_lf")))
        met = piece_pairs(said.select("_ll").distinct(), fulls.select("_lf").distinct(), "_ll", "_lf", 20000 / 90 - 200 + 1e-6)
        near = near.unionByName(met.join(said, "_ll").join(fulls, "_lf").filter(close).select("_loc", "_f"))
    near = spread(near, "_loc", "_f").distinct()
    near = near.filter(ratio(F.lower("_loc"), F.lower("_f")) >= 90)
    allowed = no_token("_loc") | no_token("_b") | F.arrays_overlap(tx.venue_tokens("_loc"), tx.venue_tokens("_b"))
    last = near.join(a, "_f").filter(allowed).groupBy("_loc").agg(F.min("address_id").alias("address_id")).withColumn("step", F.lit(5))
    found = rows.join(hits.unionByName(last), "_loc")
    return found.groupBy(key).agg(F.min_by(F.struct("address_id", "step"), F.struct("step", "address_id")).alias("m")).select(key, "m.address_id", "m.step")


def supports_candidate(raw: Column | str) -> Column:
    """Location text is consistent with an address row (building_name, street_number, street_name, direction, full_address)."""
    t = F.lower(tx.text(raw))
    num, name, full, d = (F.lower(tx.text(x)) for x in ("street_number", "street_name", "full_address", "direction"))
    building = ~tx.blank("building_name") & tx.token_overlap(tx.venue_tokens(t), tx.venue_tokens("building_name"))
    words = F.filter(F.split(name, r"[\s,/.-]+"), lambda w: (F.length(w) > 2) | w.rlike("^[0-9]+$"))
    words_ok = F.forall(words, lambda w: F.contains(t, w))
    num_ok = (num == "") | F.contains(t, num)
    dir_bad = d.isin("n", "s", "e", "w") & ~F.regexp_like(t, F.concat(F.lit(r"\b"), F.when(num != "", F.concat(num, F.lit(r"\s+"))).otherwise(""), d, F.lit(r"\b")))
    return (
        F.when(t == "", True)
        .when(~num_ok, F.when((name != "") | (full != ""), False).otherwise(building))
        .when((name != "") & ~words_ok, F.when((num != "") | (full != ""), False).otherwise(building))
        .when(dir_bad, False)
        .when((name != "") & (num != ""), True)
        .otherwise(building | (name != "") | (num != ""))
    )


def cache_lookup(df: DataFrame, cache: DataFrame, addr: DataFrame, key: str, location: str) -> DataFrame:
    """Cached address of a raw location text, dropped where the text contradicts the address."""
    cached = cache.select(F.col("raw_location").alias("_raw"), F.col("address_id").alias("_cid"))
    joined = df.select(key, F.col(location).alias("_loc")).join(cached, F.col("_loc") == F.col("_raw"))
    have = addr.join(joined.select("_cid").distinct(), addr["address_id"] == F.col("_cid"), "left_semi")
    cols = {c: (F.col(c) if c in addr.columns else F.lit("").alias(c)) for c in ("building_name", "street_number", "street_name", "direction", "full_address")}
    a = have.select(F.col("address_id").alias("_aid"), *[v.alias(c) for c, v in cols.items()])
    return joined.join(a, F.col("_cid") == F.col("_aid"), "left").filter(supports_candidate("_loc")).select(key, F.col("_cid").alias("address_id"))


def cache_insert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache plus the texts it did not have (smallest address_id per text)."""
    new = fresh.join(cache.select("raw_location"), "raw_location", "left_anti").groupBy("raw_location").agg(F.min("address_id").alias("address_id"))
    return cache.select("raw_location", "address_id").unionByName(new)


def name_in_text(df: DataFrame, addr: DataFrame, key: str, body: str, partial: Callable = fz.partial_ratio, threshold: float = 80) -> DataFrame:
    """(key, address_id, how): a building name contained in the text, else the closest one above the threshold.

    The fuzzy step looks at all names of six or more characters. Distinct texts are looked
    up, so copies of a text cost one look-up.
    """
    names = addr.filter(~tx.blank("building_name")).groupBy(F.lower(tx.text("building_name")).alias("name")).agg(F.max("address_id").alias("address_id"), F.min("address_id").alias("first_id"))
    rows = df.select(key, F.lower(tx.text(body)).alias("_text"))
    texts = cut_lineage(rows.select("_text").distinct())
    inside = contained_in_text(texts, "_text", "_text", names, "first_id", "name")
    exact = cut_lineage(inside.join(names.select("first_id", "address_id"), "first_id").groupBy("_text").agg(
        F.min_by("address_id", "first_id").alias("address_id")).withColumn("how", F.lit("contains")))
    rest = cut_lineage(texts.join(exact, "_text", "left_anti"))
    found = exact
    if not rest.isEmpty():
        long = names.filter(F.length("name") >= 6).select("name", "address_id")
        long = cut_lineage(long)  # few names need not be derived again for each side of the pairs
        near = cut_lineage(spread(close_pairs(long.select("name"), rest, "name", "_text", threshold), "name", "_text"))
        near = near.withColumn("_s", partial(F.col("name"), F.col("_text"))).filter(F.col("_s") > threshold)
        found = found.unionByName(near.join(long, "name").groupBy("_text").agg(
            F.max_by("address_id", F.struct("_s", -F.col("address_id"))).alias("address_id")).withColumn("how", F.lit("fuzzy")))
    # a text of many rows is one row here
    return rows.join(found, "_text").groupBy(key).agg(F.min(F.struct("how", "address_id")).alias("m")).select(key, "m.address_id", "m.how")


def postal_lookup(df: DataFrame, civic: DataFrame, key: str, location: str, postal: str) -> DataFrame:
    """Civic row for a postal code: the one whose number is the first number in the text, else the first row."""
    d = df.select(key, F.col(postal).alias("_pc"), F.regexp_extract(location, r"(\d+)", 1).try_cast("int").alias("_num"))
    rows = civic.select(F.col("postal_code").alias("_pc"), F.col("civic_no").alias("_num"), F.struct("civic_id", "formatted").alias("_row"))
    exact = rows.groupBy("_pc", "_num").agg(F.min("_row").alias("_exact"))
    first = rows.groupBy("_pc").agg(F.min("_row").alias("_first"))
    met = d.join(first, "_pc").join(exact, ["_pc", "_num"], "left")
    return met.groupBy(key).agg(F.min(F.struct(F.col("_exact").isNull(), F.coalesce("_exact", "_first").alias("row"))).alias("m")).select(key, "m.row.*")


def best_building(df: DataFrame, addr: DataFrame, key: str, location: str, scores: Callable = fz.name_scores, threshold: float = 85) -> DataFrame:
    """Best partial score of at least the threshold per location; poor texts and names are left out."""
    c = F.col
    loc = df.select(key, c(location).alias("left_name"))
    # the quality of a text costs far more than reading it, so each is judged once; written, or the filter would go below the grouping
    asked = spread(written(loc.select("left_name").distinct()), "left_name").filter(~tx.low_quality_location("left_name"))
    known = written(addr.groupBy("building_name", "full_address").agg(F.min("address_id").alias("address_id")))
    good = written(spread(known, "building_name", "full_address").filter(~tx.low_quality_name("building_name") & ~tx.low_quality_location("full_address")))
    sim = scored_names(written(asked).select(c("left_name").alias("name")), good.select(c("building_name").alias("name")), scores, lower=True, partial=threshold)
    by_name = good.groupBy(c("building_name").alias("right_name")).agg(F.min("address_id").alias("address_id"))
    best = sim.join(by_name, "right_name").groupBy("left_name").agg(F.max_by(F.struct("address_id", c("s.partial").alias("score")), F.struct("s.partial", -c("address_id"))).alias("m"))
    return loc.join(best, "left_name").select(key, "m.address_id", "m.score")


def best_name_match(left: DataFrame, cand: DataFrame, key: str, search: str, name: str, cand_id: str, score: Callable = fz.indel_ratio, threshold: float = 80) -> DataFrame:
    """Per row the candidate of the same search key with the best name score of at least the threshold."""
    a = left.select(key, search, F.col(name).alias("_a"))
    b = cand.groupBy(search, F.col(name).alias("_b")).agg(F.min(cand_id).alias(cand_id))
    names = a.select(search, "_a").distinct().join(b, search).withColumn("score", score(F.col("_a"), F.col("_b"))).filter(F.col("score") >= threshold)
    best = names.groupBy(search, "_a").agg(F.max_by(F.struct(cand_id, "score"), F.struct("score", -F.col(cand_id))).alias("m"))
    return a.join(best, [search, "_a"]).select(key, f"m.{cand_id}", "m.score")
