import datetime as dtm
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from curatrix.streaming import jobs

BASE = dtm.datetime(2026, 1, 1)


def simulate_breaker(rows, threshold, window, cool):
    out, state = [], {}
    for dom, ts, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        fails, until = state.get(dom, ([], None))
        if until and ts >= until:
            fails, until = [], None
        if ok:
            fails = []
        else:
            fails = [t for t in fails if t >= ts - dtm.timedelta(seconds=window)] + [ts]
            end = ts + dtm.timedelta(seconds=cool)
            if len(fails) >= threshold and (until is None or until < end):
                until = end
                out.append((dom, ts))
        state[dom] = (fails, until)
    return sorted(out)


def run(spark, tmp_path, rows, make, schema, files=1):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    df = spark.createDataFrame(rows, "domain string, ts timestamp, ok boolean")
    step = max(1, len(rows) // files)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], df.schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    jobs.run_to_table(make(stream), str(out), str(tmp_path / "ck"))
    return jobs.read_result(spark, str(out), schema).collect()


def test_breaker_matches_simulation(spark, tmp_path):
    rnd = random.Random(7)
    rows = sorted([(rnd.choice("ab"), BASE + dtm.timedelta(seconds=rnd.randrange(9000)), rnd.random() < 0.15) for _ in range(120)], key=lambda r: r[1])
    got = run(spark, tmp_path, rows, lambda s: jobs.domain_breaker(s, 3, 600, 300), jobs.BREAKER_OUT)
    assert sorted((r.domain, r.opened_at) for r in got) == simulate_breaker(rows, 3, 600, 300)


def test_cooldown_doubles_and_resets(spark, tmp_path):
    marks = [(0, False), (10, False), (20, True), (30, False), (40, False), (50, False), (60, False)]
    rows = [("s", BASE + dtm.timedelta(seconds=t), ok) for t, ok in marks]
    got = run(spark, tmp_path, rows, lambda s: jobs.adaptive_cooldown(s.withColumnRenamed("domain", "scope"), 2, 100, 300), jobs.COOLDOWN_OUT, files=2)
    assert sorted((r.strikes, r.cooldown_sec) for r in got) == [(1, 100), (2, 200), (3, 300)]


def test_first_seen_passes_once(spark, tmp_path):
    rows = [("a", BASE, True), ("a", BASE + dtm.timedelta(seconds=5), True), ("b", BASE, True)]
    got = run(spark, tmp_path, rows, lambda s: jobs.first_seen(s, ["domain"], "ts", "1 hour"), "domain string, ts timestamp, ok boolean")
    assert sorted(r.domain for r in got) == ["a", "b"]


def test_state_survives_between_batches(spark, tmp_path):
    """One file per row, with rows of other keys in between, gives what one file gives."""
    marks = [(0, "a"), (5, "z"), (10, "a"), (200, "z"), (400, "z"), (420, "a"), (900, "z"), (5000, "b"), (5001, "a")]
    rows = [(k, BASE + dtm.timedelta(seconds=t), False) for t, k in marks]
    for files in (1, len(rows)):
        (tmp_path / f"n{files}").mkdir()
        got = run(spark, tmp_path / f"n{files}", rows, lambda s: jobs.domain_breaker(s, 3, 600, 600), jobs.BREAKER_OUT, files=files)
        assert sorted((r.domain, r.opened_at) for r in got) == simulate_breaker(rows, 3, 600, 600) != []
    cool = []
    for files in (1, 3):
        (tmp_path / f"c{files}").mkdir()
        rows = [("s", BASE + dtm.timedelta(seconds=t), False) for t in (0, 120, 240)]
        got = run(spark, tmp_path / f"c{files}", rows, lambda s: jobs.adaptive_cooldown(s.withColumnRenamed("domain", "scope"), 1, 10, 300), jobs.COOLDOWN_OUT, files=files)
        cool.append(sorted(r.strikes for r in got))
    assert cool == [[1, 2, 3], [1, 2, 3]]


def test_stream_write_keeps_addresses_and_newest_rows(spark, tmp_path):
    """A repeated event replaces itself; an address that one batch adds is known to the next."""
    src, target = tmp_path / "in", str(tmp_path / "out")
    batches = [[(1, "x"), (2, "y")], [(1, "y"), (3, "x"), (4, "w")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, place string").coalesce(1).write.mode("append").parquet(str(src))
    base = spark.createDataFrame([(5, "v")], "address_id long, place string")

    def write(batch, known):
        top = known.agg(F.max("address_id").alias("top"))
        fresh = batch.select("place").distinct().join(known, "place", "left_anti")
        fresh = fresh.join(top).select((F.col("top") + F.row_number().over(Window.orderBy("place"))).alias("address_id"), "place").checkpoint()
        return batch.join(known.unionByName(fresh), "place").select("event_id", "address_id"), fresh

    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    stream = spark.readStream.schema("event_id long, place string").option("maxFilesPerTrigger", 1).parquet(str(src))
    jobs.stream_write(stream, write, target, str(tmp_path / "ck"), base, ["event_id"]).awaitTermination()
    rows = jobs.current_rows(spark, target).collect()
    assert len(rows) == 4 and len({r.event_id for r in rows}) == 4
    stored = spark.read.parquet(jobs.address_path(target)).collect()
    assert len({r.address_id for r in stored}) == len(stored) == 3 and {r.place for r in stored} == {"x", "y", "w"}
