"""Bucketed tables: what a merge rewrites, replays, and failures before the commit."""

import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import maintain
from curatrix.sources import buckets


def files_of(spark, folder):
    return {r.b: r.f for r in buckets.read(spark, folder).select(buckets.bucket_of(["k"], 8).alias("b"), F.input_file_name().alias("f")).distinct().collect()}


def rows_of(df):
    return sorted((r.k, r.v, r.w) for r in df.collect())


def test_merge_touches_only_its_buckets(spark, tmp_path):
    folder, rng = f"file://{tmp_path}/t", random.Random(3)
    schema = "k long, v string, w int"
    base = spark.createDataFrame([(k, f"v{k}", k) for k in range(200)] + [(5, "v5", 4)], schema)
    state = buckets.create(base, folder, ["k"], 8)
    assert (state.version, len(state.places)) == (0, 8)
    want, before = maintain.one_per_key(base, ["k"]), files_of(spark, folder)
    keys = [3, 77, 1000]
    for batch in range(2):
        delta = spark.createDataFrame([(k, None if rng.random() < 0.5 else f"b{batch}", batch) for k in keys], schema)
        want = spark.createDataFrame(maintain.upsert(want, delta, ["k"], True).collect(), schema)
        after = buckets.merge(delta.withColumn("extra", F.lit(1)), folder, True, batch_id=batch)
        assert after.version == batch + 1 and rows_of(buckets.read(spark, folder)) == rows_of(want)
        touched = {r.b for r in delta.select(buckets.bucket_of(["k"], 8).alias("b")).collect()}
        now = files_of(spark, folder)
        assert {b for b in now if now[b] != before.get(b)} == touched and len(touched) < 8
        before = now
    # a batch that comes again, or an older one, changes nothing
    assert buckets.merge(spark.createDataFrame([(3, "again", 9)], schema), folder, batch_id=1).version == 2
    # data of a version that was never committed is not seen, and is replaced by the next merge
    buckets._write(spark.createDataFrame([(3, "lost", 9)], schema), folder, ["k"], 8, 3)
    assert rows_of(buckets.read(spark, folder)) == rows_of(want)
    buckets.merge(spark.createDataFrame([(4, "kept", 1)], schema), folder)
    assert (4, "kept", 1) in rows_of(buckets.read(spark, folder)) and (3, "lost", 9) not in rows_of(buckets.read(spark, folder))


def test_bucket_edges(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/e", "k long, v string"
    none = spark.createDataFrame([], schema)
    assert buckets.state_of(spark, folder) is None
    with pytest.raises(ValueError):
        buckets.read(spark, folder)
    buckets.create(none, folder, ["k"])
    assert buckets.read(spark, folder).collect() == []
    buckets.merge(none, folder)
    buckets.merge(spark.createDataFrame([(1, "a")], schema), folder)
    assert [tuple(r) for r in buckets.read(spark, folder).collect()] == [(1, "a")]
    with pytest.raises(ValueError):
        buckets.merge(spark.createDataFrame([(None, "a")], schema), folder)
