"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, stage_column_stats

SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage like ``checkpoint()``, but the files are compressed and later plans
    know their size. Lost executors cost nothing that was written.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(table: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """A stored table as the broadcast side of a join if its files are at most ``limit`` bytes; else as it is.

    Beyond the limit Spark joins by key, which needs the other side's rows shuffled.
    """
    size = stage_column_stats(table)
    return F.broadcast(table) if size is not None and size <= limit else table


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans.

    It finds those by the driver's garbage collection, which seldom comes by itself when
    the driver has little to do; so jobs in rounds ask for one.
    """
    spark.sparkContext._jvm.System.gc()


def id_and_text(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Only the two columns an operator works on, so no other column can clash with its own.

    With ``carry`` the whole input row comes along as one struct ``row``.
    """
    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    return docs.select(*own, F.struct(*docs.columns).alias("row")) if carry else docs.select(*own)


def held_out(doc_id: str | Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(ids: DataFrame, rows: int) -> tuple[DataFrame, float]:
    """About ``rows`` rows of ``ids`` at most, and the share of all ids that ``sampled`` takes.

    Rows are chosen by a hash of ``doc_id``, so the choice depends neither on their order
    nor on their partitioning; the bound holds on average, as the hash is uniform.
    """
    total = ids.count()
    share = 1.0 if total <= rows else rows / total
    return sampled(ids, share), share


def sampled(df: DataFrame, share: float) -> DataFrame:
    if share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_texts(df: DataFrame, prepare: Callable[[], Callable[[list], dict]], schema: str, text: str = "text", slice_rows: int = 512) -> DataFrame:
    """Adds columns made from ``text`` by Python, in Arrow batches, without a shuffle.

    ``prepare`` runs once per task and gives a function from a list of texts to the new
    columns. Batches are handled in slices, so that few long texts are unpacked at once.
    The other columns pass through as Arrow data; ``text`` is dropped.
    """
    keep = [c for c in df.columns if c != text]
    made = StructType.fromDDL(schema)
    out = StructType([*[df.schema[c] for c in keep], *made.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                cols = work(part.column(text).to_pylist())
                new = [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], arrow.field(f.name).type) for f in made.fields]
                arrays = [part.column(c) for c in keep] + new
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, out)
