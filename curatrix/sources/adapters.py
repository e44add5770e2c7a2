"""Views that present the benchmark tables in the shape of the event domain.

Projections only: each stays a single parquet scan with pruned columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def widen(df: DataFrame) -> DataFrame:
    """Spread an input that arrives in fewer splits than there are cores, ahead of CPU-heavy expressions.

    Large inputs have many splits and pass through unchanged, so nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return widen(table(spark, sf_dir, name))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows: date, seconds of day, place and source from the event stream table."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(e: DataFrame) -> DataFrame:
    start = day_seconds("ts")
    return e.select(
        "event_id",
        F.to_date("ts").alias("start_date"),
        start.alias("start_sec"),
        ((start + F.floor(F.col("value") * 60)) % 86400).cast("int").alias("end_sec"),
        "event_type",
        F.col("event_type").alias("source"),
        F.col("user_id").alias("place"),
        "ts",
        "value",
        "props",
    )


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl log: one row per attempt, links by user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("link"),
        F.col("event_type").isin("purchase", "signup").alias("relevant"),
        F.lit(1).alias("crawl_try"),
        F.col("ts").alias("time_stamp"),
        F.col("event_type").alias("source"),
        "event_id",
    )


def customer_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address table from customers: nation is the city, region the country.

    The nation and region sides are fixed-size dimensions of the benchmark schema.
    """
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_custkey").alias("address_id"),
            F.col("c_name").alias("building_name"),
            (F.col("c_custkey") % 500).cast("string").alias("street_number"),
            F.concat(F.lit("Street "), (F.col("c_custkey") % 37).cast("string")).alias("street_name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country_id"),
            F.col("c_nationkey").alias("nation_key"),
            F.col("c_mktsegment").alias("province_or_state"),
        )
    )


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
