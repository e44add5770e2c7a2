"""Average-linkage clusters as rounds of joins over weighted links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy as fz
from ..session import written
from .keyed import spread

#: Averages are compared to so many digits, so that the order of a sum does not matter.
DIGITS = 9


def average_linkage(items: DataFrame, links: DataFrame, cut: float, score: Callable = fz.indel_ratio) -> DataFrame:
    """(id, cluster): clusters whose mean distance, 100 - score over all pairs by weight, is at most ``cut``.

    ``items``: id, name, w (how many rows an item stands for). ``links``: id_a, id_b, score
    of all pairs, each once, of items that may cluster and have a distance of at most ``cut``. A cluster is
    named by its smallest id; items without a link are clusters of their own.

    Each round merges all pairs of clusters that are each other's nearest neighbour. The
    mean distance of a merged cluster lies between those of its parts, so this gives the
    clusters of merging the nearest pair one at a time; of equal distances the pair with the
    smaller ids goes first. Pairs of clusters carry the sum and the weight of their known
    distances. What was never linked is further apart than ``cut``, so a pair is only
    scored in full when its known part still allows a mean within ``cut``; the members of
    just these two clusters meet then. No task holds a cluster or a matrix.
    """
    c = F.col
    own = items.select("id", "name", c("w").cast("double").alias("w"))
    weight = own.select(c("id").alias("k"), c("w").alias("wk"))
    ends = lambda side: weight.select(c("k").alias(f"id_{side}"), c("wk").alias(f"w_{side}"))
    known = links.join(ends("a"), "id_a").join(ends("b"), "id_b").select(
        F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi"), ((100.0 - c("score")) * c("w_a") * c("w_b")).alias("total"), (c("w_a") * c("w_b")).alias("mass"),
    ).withColumn("whole", F.lit(True))
    known = written(known)
    members = written(own.withColumn("cluster", c("id")))
    while True:
        mean = F.round(c("total") / c("mass"), DIGITS)
        near = known.filter(c("whole") & (mean <= cut)).select(mean.alias("d"), "lo", "hi")
        edge = F.struct("d", "lo", "hi")
        picks = near.select(c("lo").alias("k"), edge.alias("e")).unionByName(near.select(c("hi").alias("k"), edge.alias("e"))).groupBy("k").agg(F.min("e").alias("e"))
        # an edge that both of its ends pick
        merges = written(picks.groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(c("e.hi").alias("gone"), c("e.lo").alias("into")))
        if merges.isEmpty():
            return members.select("id", "cluster")
        members = written(members.join(merges, c("cluster") == c("gone"), "left").withColumn("cluster", F.coalesce("into", "cluster")).drop("gone", "into"))
        sizes = members.groupBy("cluster").agg(F.sum("w").alias("size"))
        known = written(_merged(known, merges, members, sizes, cut, score))


def _merged(known: DataFrame, merges: DataFrame, members: DataFrame, sizes: DataFrame, cut: float, score: Callable) -> DataFrame:
    """Pairs of clusters after ``merges``; those that can lie within ``cut`` have all their distances."""
    c = F.col
    moved = known
    for side in ("lo", "hi"):
        to = merges.select(c("gone").alias(side), c("into").alias(f"_{side}"))
        moved = moved.join(to, side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    pairs = moved.filter("lo <> hi").groupBy(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.sum("total").alias("total"), F.sum("mass").alias("mass"))
    for side in ("lo", "hi"):
        pairs = pairs.join(sizes.select(c("cluster").alias(side), c("size").alias(f"n_{side}")), side)
    full = c("n_lo") * c("n_hi")
    whole = c("mass") >= full - 0.5
    possible = c("total") + (full - c("mass")) * cut <= cut * full + 1e-6
    pairs = written(pairs.select("lo", "hi", "total", "mass", whole.alias("whole"), (~whole & possible).alias("open")))
    wanted = pairs.filter("open").select("lo", "hi")
    side = lambda k: members.select(c("cluster").alias(k), c("name").alias(f"name_{k}"), c("w").alias(f"w_{k}"))
    scored = spread(wanted.join(side("lo"), "lo").join(side("hi"), "hi"), "name_lo", "name_hi").withColumn("d", 100.0 - score(c("name_lo"), c("name_hi")))
    told = scored.groupBy("lo", "hi").agg(F.sum(c("d") * c("w_lo") * c("w_hi")).alias("total"), F.sum(c("w_lo") * c("w_hi")).alias("mass"), F.lit(True).alias("whole"))
    return pairs.filter("not open").drop("open").unionByName(told)
