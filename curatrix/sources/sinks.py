"""Writers. Each target is overwritten whole or by partition, so a retried job gives the same table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_events(df: DataFrame, source_column: str, source: str, path: str, loaded_at: str) -> None:
    """One source's rows as CSV, stamped with the load time."""
    df.filter(F.col(source_column) == source).withColumn("time_stamp", F.lit(loaded_at)).write.mode("overwrite").option("header", True).csv(path)


def import_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def publish_tables(spark: SparkSession, tables: dict[str, DataFrame], target: str, gates: DataFrame | None = None, partition_by: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Copy tables to ``target`` after the gates pass; returns written and expected row counts.

    ``gates`` is the one-row result of the promotion gate. Counts are recomputed from
    what was written.
    """
    if gates is not None and gates.filter(~F.col("promote")).limit(1).count():
        raise RuntimeError("promotion gate failed; nothing was published")
    reports = []
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{target}/{name}")
        written = spark.read.parquet(f"{target}/{name}").agg(F.count(F.lit(1)).alias("written_rows"))
        expected = df.agg(F.count(F.lit(1)).alias("expected_rows"))
        reports.append(written.join(F.broadcast(expected)).select(F.lit(name).alias("table"), "written_rows", "expected_rows"))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out
