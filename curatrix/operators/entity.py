"""De-duplication and entity resolution. Results do not depend on row order."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy as fz
from ..functions import text as tx
from ..functions import urls as u
from ..session import cut_lineage
from .gates import low_quality_location_penalty
from .graph import connected_components
from .keyed import spread, with_group_agg
from .linkage import average_linkage
from .rules import source_penalties
from .vectors import TILE_ROWS, similar_pairs


def name_pairs(names: DataFrame, block: Sequence[str], name: str, key: str, threshold: float, score: Callable = fz.indel_ratio) -> DataFrame:
    """Pairs of distinct names in one block scoring above ``threshold``.

    A score above t needs lengths within a factor (200-t)/t, so names are also keyed by
    a logarithmic length class and meet only their own class and the next one: exact,
    and it splits a large block. ``names`` must hold each name once per block.
    """
    factor = (200.0 - threshold) / threshold
    cls = F.floor(F.log(F.greatest(F.length(name), F.lit(1)).cast("double")) / math.log(factor) + 1e-9)
    base = spread(names, *block, name).withColumns({"_len": F.length(name), "_cls": cls})
    a = base.withColumn("_c", F.explode(F.array(F.col("_cls"), F.col("_cls") + 1))).select(
        *block, F.col("_c"), F.col(name).alias("_na"), F.col(key).alias("id_a"), F.col("_len").alias("_la")
    )
    b = base.select(*block, F.col("_cls").alias("_c"), F.col(name).alias("_nb"), F.col(key).alias("id_b"), F.col("_len").alias("_lb"))
    ordered = (F.col("_la") < F.col("_lb")) | ((F.col("_la") == F.col("_lb")) & (F.col("_na") < F.col("_nb")))
    near = F.col("_la") * 200.0 > F.lit(threshold) * (F.col("_la") + F.col("_lb"))
    met = a.join(b, [*block, "_c"]).filter(ordered & near)
    return met.withColumn("score", score(F.col("_na"), F.col("_nb"))).filter(F.col("score") > threshold).select("id_a", "id_b", "score")


def survivor_rank(df: DataFrame, filled: Sequence[str], source="source", url="url", stamp="time_stamp", key="event_id") -> Column:
    """Struct that sorts the preferred row first: source fits URL, has URL, most filled, newest, lowest id."""
    count = F.lit(0)
    for c in filled:
        count = count + F.when(F.col(c).isNotNull(), 1).otherwise(0)
    return F.struct(
        (~u.source_matches_url(source, url)).alias("a"), tx.blank(url).alias("b"), (-count).alias("c"),
        (-F.unix_micros(F.col(stamp).cast("timestamp"))).alias("d"), F.col(key).alias("e"),
    )


def coalesce_group(df: DataFrame, group: str, rank: str, columns: Sequence[str]) -> DataFrame:
    """One row per group: each column is its first non-blank value in rank order."""
    return df.groupBy(group).agg(*[
        F.min_by(c, F.when(~tx.blank(c), F.col(rank))).alias(c) for c in columns
    ])


def fuzzy_dedup(
    df: DataFrame, block: Sequence[str], name: str = "event_name", key: str = "event_id", threshold: float = 80,
    score: Callable = fz.indel_ratio, columns: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(survivors, merged): rows of one block with similar names collapse to the preferred row.

    Equal names collapse first, so copies are never paired; similar names are linked and
    closed transitively. The survivor takes missing values from the rows it replaces.
    ``merged`` lists (key, component, is_canonical) of every row in a group of two or more.
    """
    columns = list(columns or df.columns)
    rows = df.dropna(subset=[*block, name])
    names = rows.groupBy(*block, name).agg(F.min(key).alias("_nid"))
    links = name_pairs(names, block, name, "_nid", threshold, score)
    comp = connected_components(links, "id_a", "id_b").select(F.col("id").alias("_nid"), F.col("component").alias("_c"))
    placed = rows.join(names, [*block, name]).join(comp, "_nid", "left").withColumn("component", F.coalesce("_c", "_nid")).drop("_c", "_nid")
    sized = with_group_agg(placed, ["component"], _n=F.count(F.lit(1))).filter("_n > 1")
    ranked = sized.withColumn("_rank", survivor_rank(sized, [c for c in columns if c != key], key=key))
    best = ranked.groupBy("component").agg(F.min("_rank").alias("_best"))
    rest = [c for c in columns if c != key]
    filled = coalesce_group(ranked, "component", "_rank", rest).join(best, "component").select(
        F.col("_best.e").alias(key), *rest, "component"
    )
    merged = ranked.join(best, "component").select(key, "component", (F.col(key) == F.col("_best.e")).alias("is_canonical"))
    return filled, merged


def merge_longest(pairs: DataFrame, columns: Sequence[str], left: str = "_1", right: str = "_2") -> DataFrame:
    """Per column the longer text; the stored one on ties and when the new one is blank."""
    def pick(c):
        a, b = F.col(c + left), F.col(c + right)
        return F.when(tx.blank(a), b).when(~tx.blank(b) & (F.length(b) > F.length(a)), b).otherwise(a).alias(c)

    return pairs.select(*[c for c in pairs.columns if not c.endswith((left, right))], *[pick(c) for c in columns])


def canonical_score(df: DataFrame, addresses: DataFrame, penalties: DataFrame) -> DataFrame:
    """Adds ``score``: weighted presence of fields, description length, minus source penalties.

    ``penalties``: source_equals, source_contains, penalty. Rows without a location score -infinity.
    """
    a = addresses.select(F.col("address_id").alias("_a"), F.col("postal_code").isNotNull().alias("_post"))
    src = F.lower(tx.text("source"))
    weights = source_penalties(df.select(src.alias("_t")), penalties)
    j = df.join(a, df["address_id"] == a["_a"], "left").join(weights, src == F.col("_t"), "left")

    score = (
        low_quality_location_penalty("location")
        + F.when(u.source_matches_url("source", "url"), 2.0).otherwise(0.0)
        + F.when(F.col("address_id").isNotNull(), 1.0).otherwise(0.0)
        + F.when(F.col("_post"), 1.0).otherwise(0.0)
    )
    for c in ("location", "description", "event_name"):
        score = score - F.when(F.coalesce(F.col(c), F.lit("")) == "", 1.0).otherwise(0.0)
    for c in ("source", "dance_style", "event_type", "start_sec", "url"):
        score = score + F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 0.5).otherwise(0.0)
    score = score + F.coalesce(F.length("description") * 0.01, F.lit(0.0))
    score = score - F.coalesce("_penalty", F.lit(0.0))
    missing = F.coalesce(F.col("location"), F.lit("")) == ""
    return j.withColumn("score", F.when(missing, F.lit(float("-inf"))).otherwise(score)).drop("_a", "_post", "_t", "_penalty")


def mark_canonical(df: DataFrame, cluster: str, key: str = "event_id", score: str = "score") -> DataFrame:
    """Adds ``is_canonical``: highest score per cluster, lowest id on ties."""
    best = df.groupBy(cluster).agg(F.max_by(key, F.struct(F.col(score), -F.col(key))).alias("_best"))
    joined = df.join(best.withColumnRenamed(cluster, "_bc"), df[cluster] == F.col("_bc"))
    return joined.withColumn("is_canonical", F.col(key) == F.col("_best")).drop("_bc", "_best")


def similar_vectors(df: DataFrame, block: Sequence[str], key: str, vector: str, min_similarity: float, tile_rows: int = TILE_ROWS, extra: str | None = None) -> DataFrame:
    """Pairs (id_a < id_b) of one block whose cosine similarity reaches the limit (see ``similar_pairs``).

    ``extra`` is a further condition in SQL over columns of both sides (a. and b.), joined
    to the few pairs that pass.
    """
    pairs = similar_pairs(df, block, key, vector, min_similarity, tile_rows)
    if extra is None:
        return pairs
    left, right = df.select(F.struct("*").alias("a")), df.select(F.struct("*").alias("b"))
    return (
        pairs.join(left, pairs["id_a"] == left[f"a.{key}"]).join(right, pairs["id_b"] == right[f"b.{key}"])
        .filter(F.expr(extra)).select("id_a", "id_b", "similarity")
    )


def density_clusters(pairs: DataFrame, min_points: int = 2) -> DataFrame:
    """(id, component) of density clusters over neighbour pairs; a point counts itself.

    With two points this is the connected components of the pair graph. For more, core
    points are linked and border points join their smallest core cluster.
    """
    if min_points <= 2:
        return connected_components(pairs, "id_a", "id_b")
    both = pairs.select("id_a", "id_b").unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    core = both.groupBy("id_a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") + 1 >= min_points).select(F.col("id_a").alias("core"))
    inner = pairs.join(core.withColumnRenamed("core", "id_a"), "id_a", "left_semi").join(core.withColumnRenamed("core", "id_b"), "id_b", "left_semi")
    comps = connected_components(inner, "id_a", "id_b")
    alone = core.join(comps, core["core"] == comps["id"], "left_anti").select(F.col("core").alias("id"), F.col("core").alias("component"))
    cores = comps.unionByName(alone)
    border = both.join(core.withColumnRenamed("core", "id_a"), "id_a", "left_anti").join(
        cores, both["id_b"] == cores["id"]).groupBy(F.col("id_a").alias("id")).agg(F.min("component").alias("component"))
    return cores.unionByName(border)


def embedding_clusters(
    df: DataFrame, addresses: DataFrame, penalties: DataFrame, vector: str, eps: float = 0.3, min_points: int = 2, window: int = 1800
) -> DataFrame:
    """Event rows in near-duplicate clusters, with the canonical row marked.

    Candidates share the date, start within ``window`` seconds and have the same or an
    unknown address. Rows are cut into time slices as long as the window and appear in
    their own and the next slice, so a block is a slice, not a day.
    """
    timed = df.dropna(subset=["start_date", "start_sec"]).withColumn("_slice", F.floor(F.col("start_sec") / window))
    both = timed.withColumn("_slice", F.explode(F.array(F.col("_slice"), F.col("_slice") + 1)))
    slim = both.select("event_id", "start_date", "_slice", "start_sec", "address_id", vector)
    near = similar_vectors(slim, ["start_date", "_slice"], "event_id", vector, 1 - eps).select("id_a", "id_b").distinct()
    facts = timed.select("event_id", "start_sec", "address_id")
    a = facts.select(F.col("event_id").alias("id_a"), F.col("start_sec").alias("_sa"), F.col("address_id").alias("_aa"))
    b = facts.select(F.col("event_id").alias("id_b"), F.col("start_sec").alias("_sb"), F.col("address_id").alias("_ab"))
    ok = (F.abs(F.col("_sa") - F.col("_sb")) <= window) & F.coalesce(F.col("_aa") == F.col("_ab"), F.lit(True))
    pairs = near.join(a, "id_a").join(b, "id_b").filter(ok).select("id_a", "id_b")
    comp = density_clusters(pairs, min_points)
    members = df.join(comp, df["event_id"] == comp["id"]).drop("id")
    return mark_canonical(canonical_score(members, addresses, penalties), "component")


def name_subclusters(
    df: DataFrame, cluster: str, name: str, key: str, cut: float = 30, fine_cut: float = 15, fine_from: int = 5, score: Callable = fz.indel_ratio
) -> DataFrame:
    """(key, subcluster): rows of a cluster split by average linkage of their names.

    Distinct names are linked where their distance is within ``cut``; clusters of names
    that stand for ``fine_from`` rows or more are split once more at ``fine_cut``. Rows
    without a name stay alone.
    """
    named = df.filter(~tx.blank(name))
    names = cut_lineage(named.groupBy(cluster, name).agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("w")))
    links = cut_lineage(name_pairs(names, [cluster], name, "id", 100 - cut - 1e-9, score))
    items = names.select("id", F.col(name).alias("name"), "w")
    coarse = cut_lineage(average_linkage(items, links, cut, score))
    large = items.join(coarse, "id").groupBy("cluster").agg(F.sum("w").alias("_n")).filter(F.col("_n") >= fine_from).select("cluster")
    inner = coarse.join(large, "cluster")
    ends = [inner.select(F.col("id").alias(f"id_{s}"), F.col("cluster").alias(f"_{s}")) for s in "ab"]
    close = links.filter(F.col("score") >= 100 - fine_cut - 1e-9).join(ends[0], "id_a").join(ends[1], "id_b").filter("_a = _b").select("id_a", "id_b", "score")
    fine = average_linkage(items.join(inner.select("id"), "id"), close, fine_cut, score)
    split = coarse.join(fine.withColumnRenamed("cluster", "_fine"), "id", "left").select("id", F.coalesce("_fine", "cluster").alias("subcluster"))
    with_id = named.join(names.select(cluster, name, "id"), [cluster, name]).join(split, "id")
    return with_id.select(key, "subcluster").unionByName(df.filter(tx.blank(name)).select(key, F.col(key).alias("subcluster")))


def address_cluster_rules(df: DataFrame, subcluster: str = "subcluster") -> DataFrame:
    """(subcluster, size, decision): skip, resolve or review by the ordered rules; groups of five or more are skipped by size."""
    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        norm = lambda c: [str(v or "").strip().lower() for v in pdf[c]]
        names, numbers, streets, cities = norm("building_name"), norm("street_number"), norm("street_name"), norm("city")
        real = [x for x in names if x not in ("", "null")]
        decision = None
        if any(fz.token_sort(a, b) > 90 for i, a in enumerate(real) for b in real[i + 1:]):
            decision = "review_similar_names"
        elif len(set(numbers)) == len(numbers):
            decision = "skip_unique_numbers"
        else:
            for number in {x for x in numbers if x and numbers.count(x) > 1}:
                at = [i for i, x in enumerate(numbers) if x == number]
                if len({streets[i] for i in at}) > 1:
                    decision = "skip_street_names_differ"
                elif len({cities[i] for i in at if cities[i]}) > 1:
                    decision = "skip_cities_differ"
        if decision is None and len(set(names)) > 1:
            decision = "skip_building_names_differ"
        if decision is None:
            decision = "resolve" if any(streets) or any(norm("postal_code")) else "review_conflicting_numbers"
        return pd.DataFrame({"subcluster": [pdf["subcluster"].iloc[0]], "size": [len(pdf)], "decision": [decision]})

    sized = with_group_agg(df.withColumnRenamed(subcluster, "subcluster"), ["subcluster"], _n=F.count(F.lit(1)))
    few = sized.filter(F.col("_n").between(2, 4)).select("subcluster", "building_name", "street_number", "street_name", "city", "postal_code")
    many = sized.filter(F.col("_n") > 4).groupBy("subcluster").agg(F.count(F.lit(1)).cast("int").alias("size"), F.lit("skip_large_group").alias("decision"))
    return few.groupBy("subcluster").applyInPandas(decide, "subcluster bigint, size int, decision string").unionByName(many)


def resolved_mapping(mapping: DataFrame) -> DataFrame:
    """(duplicate_id, canonical_id) with chains followed to their end, by doubling the steps."""
    m = mapping.filter(F.col("duplicate_id") != F.col("canonical_id")).groupBy("duplicate_id").agg(F.min("canonical_id").alias("canonical_id"))
    m = cut_lineage(m)
    for _ in range(max(1, m.count()).bit_length() + 1):
        after = m.select(F.col("duplicate_id").alias("_d"), F.col("canonical_id").alias("_next"))
        linked = m.join(after, m["canonical_id"] == after["_d"], "left")
        if linked.filter("_next is not null").isEmpty():
            return m
        m = cut_lineage(linked.select("duplicate_id", F.coalesce("_next", "canonical_id").alias("canonical_id")))
    # what still points at a duplicate after as many doublings as there are rows is in a cycle or leads to one
    return m.join(m.select(F.col("duplicate_id").alias("_d")), F.col("canonical_id") == F.col("_d"), "left_anti")


def apply_merge(dim: DataFrame, facts: DataFrame, mapping: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(dim, facts) after duplicates are repointed to their canonical row. ``mapping``: duplicate_id, canonical_id.

    A duplicate with several targets takes the smallest; chains lead to their end, and
    the members of a cycle stay as they are.
    """
    m = resolved_mapping(mapping)
    kept = dim.join(m, dim[key] == m["duplicate_id"], "left_anti")
    moved = facts.join(m, facts[key] == m["duplicate_id"], "left").withColumn(key, F.coalesce("canonical_id", key)).drop("duplicate_id", "canonical_id")
    return kept, moved


def conflict_decisions(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Complete and validate keep/delete decisions on conflict pairs; adds correct, incorrect and verdict."""
    d = decisions.select(F.col("event_id_1").alias("_1"), F.col("event_id_2").alias("_2"), "correct_event_id", "incorrect_event_id")
    j = pairs.join(d, (pairs["event_id_1"] == d["_1"]) & (pairs["event_id_2"] == d["_2"]))
    a, b = F.col("event_id_1"), F.col("event_id_2")

    def other(c):
        return F.when(F.col(c) == a, b).when(F.col(c) == b, a)

    right = F.coalesce("correct_event_id", other("incorrect_event_id"))
    wrong = F.coalesce("incorrect_event_id", other("correct_event_id"))
    verdict = (
        F.when(right.isNull() | wrong.isNull() | ~right.isin(a, b) | ~wrong.isin(a, b), "ids_outside_pair")
        .when(right == wrong, "same_id").otherwise("valid")
    )
    return j.select(a, b, right.alias("correct"), wrong.alias("incorrect"), verdict.alias("verdict"))


def first_per_signature(df: DataFrame, signature: str, order: str) -> DataFrame:
    """Keep the first row of each signature."""
    rest = [c for c in df.columns if c != signature]
    best = df.groupBy(signature).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select(signature, *[F.col(f"_r.{c}").alias(c) for c in rest])
