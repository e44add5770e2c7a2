"""Tables in hash buckets with a manifest: an upsert rewrites only the buckets its keys fall into.

A version of the table is a set of bucket folders, named by the rows of its manifest. Files
are never changed: a merge writes the buckets it touches as a new version and then commits a
manifest that names them beside the old ones. Readers see the last whole manifest, so a
merge that fails leaves the table as it was. One writer at a time is assumed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.maintain import one_per_key, upsert
from ..session import written

BUCKETS = 64
#: The manifest: one row per bucket that has rows, and one of bucket -1 with the table's settings.
MANIFEST = "bucket int, data_version int, batch_id long, settings string"


class State(NamedTuple):
    version: int
    batch_id: int
    keys: list[str]
    buckets: int
    schema: T.StructType
    places: dict[int, int]


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def state_of(spark: SparkSession, folder: str) -> State | None:
    """The last committed version; None where there is no table."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    last = rows.agg(F.max("version").alias("v")).first().v
    if last is None:
        return None
    found = rows.filter(F.col("version") == last).collect()  # one row per bucket
    head = next(r for r in found if r.bucket == -1)
    settings = json.loads(head.settings)
    return State(last, head.batch_id, settings["keys"], settings["buckets"], T.StructType.fromJson(settings["schema"]), {r.bucket: r.data_version for r in found if r.bucket >= 0})


def _commit(spark: SparkSession, folder: str, state: State) -> None:
    settings = json.dumps({"keys": state.keys, "buckets": state.buckets, "schema": state.schema.jsonValue()})
    rows = [(-1, None, state.batch_id, settings), *((b, v, None, None) for b, v in sorted(state.places.items()))]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={state.version}")


def _write(df: DataFrame, folder: str, keys: Sequence[str], buckets: int, version: int) -> list[int]:
    """Writes rows as the data of a version and returns the buckets that have some."""
    place = f"{folder}/data/version={version}"
    dealt = df.withColumn("_bucket", bucket_of(keys, buckets))
    dealt.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(place)
    try:
        return [r._bucket for r in df.sparkSession.read.schema("_bucket int").parquet(place).select("_bucket").distinct().collect()]
    except AnalysisException:  # no row at all
        return []


def create(df: DataFrame, folder: str, keys: Sequence[str], buckets: int = BUCKETS, batch_id: int = -1) -> State:
    """A new table of one row per key."""
    _refuse_null_keys(df, keys)
    full = _write(one_per_key(df, keys), folder, keys, buckets, 0)
    state = State(0, batch_id, list(keys), buckets, df.schema, {b: 0 for b in full})
    _commit(df.sparkSession, folder, state)
    return state


def read(spark: SparkSession, folder: str, only: Sequence[int] | None = None) -> DataFrame:
    """Rows of the table, or those of the buckets in ``only``."""
    state = state_of(spark, folder)
    if state is None:
        raise ValueError(f"no table in {folder}")
    paths = [f"{folder}/data/version={v}/_bucket={b}" for b, v in sorted(state.places.items()) if only is None or b in only]
    return spark.read.schema(state.schema).parquet(*paths) if paths else spark.createDataFrame([], state.schema)


def merge(delta: DataFrame, folder: str, keep_old_on_null: bool = False, batch_id: int | None = None) -> State:
    """Upserts ``delta`` by the table's keys (see ``upsert``) and commits a new version.

    Only the buckets of the delta's keys are read and written. With ``batch_id`` a batch
    that is not newer than the last one committed changes nothing, so it may be replayed.
    Null keys are refused. Columns that the table does not have are ignored.
    """
    spark = delta.sparkSession
    state = state_of(spark, folder)
    if state is None:
        raise ValueError(f"no table in {folder}")
    if batch_id is not None and batch_id <= state.batch_id:
        return state
    known = [f.name for f in state.schema if f.name in delta.columns]
    rows = written(delta.select(*known))
    _refuse_null_keys(rows, state.keys)
    touched = [r.b for r in rows.select(bucket_of(state.keys, state.buckets).alias("b")).distinct().collect()]
    version = state.version + 1
    full = _write(upsert(read(spark, folder, touched), rows, state.keys, keep_old_on_null), folder, state.keys, state.buckets, version) if touched else []
    after = state._replace(version=version, batch_id=state.batch_id if batch_id is None else batch_id, places=state.places | {b: version for b in full})
    _commit(spark, folder, after)
    return after


def _refuse_null_keys(df: DataFrame, keys: Sequence[str]) -> None:
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    if not df.filter(null).isEmpty():
        raise ValueError(f"null in the keys {list(keys)}")
