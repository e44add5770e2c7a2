"""Connected components of pair graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component): transitive groups, named by their smallest id.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each step is a
    minimum per node joined back to the edges, so a hub's edges are never gathered in
    one task, and the number of rounds grows with the logarithm of the graph. Every
    round is written to the shared checkpoint folder.
    """
    edges = pairs.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u <> v").distinct()
    edges = cut_lineage(edges)
    state = _fingerprint(edges)
    before = None
    while state != before:
        edges = cut_lineage(_small_star(_large_star(edges)))
        before, state = state, _fingerprint(edges)
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return linked.unionByName(own).filter("u <> v").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
