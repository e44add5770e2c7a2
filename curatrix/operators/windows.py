"""Window-style operators, arranged so that no window runs over one global or one hot partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .keyed import global_rank, top_per_key


def quarter_hour_groups(df: DataFrame, since: Column, mode: str = "exact", step: int = 900) -> DataFrame:
    """Rows of (date, quarter hour of start, quarter hour of end) groups with more than one row, with a dense group id.

    ``exact`` compares the minute of a row's own times with the group's quarter hour, as
    the stored query does; ``floored`` puts both sides on the quarter hour. Group ids are
    ranked over the distinct groups, never over the rows.
    """
    def to_step(c):
        return (F.floor(F.col(c) / step) * step).cast("long")

    def to_minute(c):
        return (F.floor(F.col(c) / 60) * 60).cast("long")

    pick = to_step if mode == "floored" else to_minute
    dated = df.filter(F.col("start_date") > since).withColumns({"_s": to_step("start_sec"), "_e": to_step("end_sec")})
    groups = dated.groupBy("start_date", "_s", "_e").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _s is not null and _e is not null").drop("_n")
    rows = df.withColumns({"_s": pick("start_sec"), "_e": pick("end_sec")}).join(groups, ["start_date", "_s", "_e"])
    present = rows.select("start_date", "_s", "_e").distinct()
    ranked = global_rank(present, ["start_date", "_s", "_e"], "group_id")
    return rows.join(ranked, ["start_date", "_s", "_e"]).drop("_s", "_e")


def duplicate_address_groups(addr: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Addresses that share a street line or a building name with another one, with the group's dense id.

    The group of an address is the smallest id it meets in any of its keys. That minimum
    is a per-key aggregate, so no pairs are built; NULL and '' keys never match.
    """
    marks = None
    for keys in key_sets:
        cond = F.lit(True)
        for k in keys:
            cond = cond & ~tx.blank(k)
        keyed = addr.filter(cond).select(F.xxhash64(*[F.lower(k) for k in keys]).alias("_h"), *[F.lower(k).alias(f"_{k}") for k in keys], "address_id")
        named = [f"_{k}" for k in keys]
        shared = keyed.groupBy("_h", *named).agg(F.min("address_id").alias("_g"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        part = keyed.join(shared, ["_h", *named]).select("address_id", "_g")
        marks = part if marks is None else marks.unionByName(part)
    one_hop = marks.groupBy("address_id").agg(F.min("_g").alias("_g"))
    ranked = global_rank(one_hop.select("_g").distinct(), ["_g"], "group_id")
    return one_hop.join(ranked, "_g").select("group_id", "address_id")


def failure_streak(log: DataFrame, key: str, stamp: str, ok: str, newest: int = 5, tie: str | None = None) -> DataFrame:
    """Consecutive failures counted back from the newest attempt, within the newest few."""
    order = [F.desc(stamp)] + ([F.desc(tie)] if tie else [])
    last = top_per_key(log.select(key, stamp, ok, *([tie] if tie else [])), [key], order, newest)
    return last.groupBy(key).agg(
        F.coalesce(F.min(F.when(F.col(ok), F.col("rn"))) - 1, F.count(F.lit(1))).alias("streak"), F.count(F.lit(1)).alias("attempts")
    )


def rank_in_run(counts: DataFrame, run: str, value: str, tie: str) -> DataFrame:
    """Position by count within each run; one row per (run, source), so runs are small groups."""
    w = Window.partitionBy(run).orderBy(F.desc(value), F.asc(tie))
    return counts.withColumn("rank_in_run", F.row_number().over(w))


def trailing_count(df: DataFrame, key: str, epoch: str, seconds: int, out: str = "recent") -> DataFrame:
    """Rows of the same key in the trailing ``seconds`` up to and including each row.

    A key's rows are cut into time slices as long as the window. Counts inside a slice
    come from a window over (key, slice); the part of the window that reaches into the
    slice before is answered by carrying that slice's rows along. A hot key is thereby
    spread over its slices instead of landing in one task.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(epoch) / seconds))
    own = sliced.withColumn("_own", F.lit(True))
    carried = sliced.select(key, epoch, (F.col("_slice") + 1).alias("_slice")).withColumn("_own", F.lit(False))
    w = Window.partitionBy(key, "_slice").orderBy(epoch).rangeBetween(-seconds, 0)
    counted = own.unionByName(carried, allowMissingColumns=True).withColumn(out, F.count(F.lit(1)).over(w))
    return counted.filter("_own").drop("_own", "_slice")
