"""Keyed building blocks that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written


def null_safe(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def with_group_agg(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row.

    Aggregates are combined map-side and joined back, instead of a window: a window
    would pull a hot group into one task, while the join can be split by AQE.
    """
    alias = {k: f"_k_{k}" for k in keys}
    groups = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    groups = groups.select(*[F.col(k).alias(a) for k, a in alias.items()], *aggs)
    cond = F.lit(True)
    for k, a in alias.items():
        cond = cond & df[k].eqNullSafe(groups[a])
    return df.join(groups, cond).drop(*alias.values())


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key. The rank filter is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_by_limit(df: DataFrame, keys: Sequence[str], limit: Column, order: Sequence[Column], salt: Column, rank: str = "rn", salts: int = 16) -> DataFrame:
    """First ``limit`` rows per key, where the limit is a column that is the same within a key.

    No group limit can be pushed down for such a limit. Rows are therefore ranked by salted
    parts of a key first, so a task of the last rank sees ``salts`` times the limit at most.
    """
    part = Window.partitionBy(*keys, F.pmod(F.xxhash64(salt), F.lit(salts))).orderBy(*order)
    few = df.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= limit)
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= limit)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key (greatest ``order`` tuple), by map-side combined aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def global_rank(keys: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """1..n over ``keys`` in the given order, without a window.

    Rows are range-partitioned and sorted on the order columns and written to the
    checkpoint folder, so their places stay as they are. A row's rank is its place in its
    partition plus the rows of the partitions before it. Ranges are cut by all order
    columns, so no single value of the first one decides how much a task gets; only one
    count per partition reaches the driver. Rows that are equal in all order columns get
    neighbouring ranks.
    """
    spark = keys.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = keys.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the generated id is the partition's number in its upper bits and the row's place in the lower 33
    placed = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(out, place + F.col("_before") + 1).drop("_at", "_part", "_before")


def once_per_value(rows: DataFrame, value: str, **made: Column) -> DataFrame:
    """``rows`` with columns made from ``value`` alone, which are worked out once per distinct value, on all tasks."""
    known = spread(rows.select(F.col(value).alias("_value")).distinct().select(F.col("_value").alias(value)), value)
    known = written(known.select(F.col(value).alias("_value"), *[c.alias(n) for n, c in made.items()]))
    return rows.join(known, rows[value].eqNullSafe(known["_value"])).drop("_value")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition rows in front of a CPU-heavy Python step.

    Such rows are small in bytes, so adaptive coalescing would put them into few tasks;
    an explicit partition count keeps all cores busy. Grouping on the same columns
    afterwards needs no further shuffle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)
