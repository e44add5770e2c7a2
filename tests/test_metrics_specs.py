import datetime as dtm

from pyspark.sql import functions as F

from curatrix.operators import gates
from curatrix.operators import maintain
from curatrix.operators import metrics as m
from curatrix.operators import selection as sel
from curatrix.sources import readers as rd


def test_step_rates(spark):
    """Rates that the telemetry spec names for one step."""
    flags = list(m.STEP_FLAGS)
    counts = dict(access_attempted=9, access_succeeded=9, text_extracted=8, keywords_found=6, extraction_attempted=8, extraction_succeeded=5)
    rows = [tuple(["scraper.py", "pipeline", 1 if i < 5 else 0] + [i < counts.get(f, 0) for f in flags]) for i in range(10)]
    schema = "handled_by string, step_name string, events_written int, " + ", ".join(f"{f} boolean" for f in flags)
    r = m.step_telemetry(spark.createDataFrame(rows, schema)).first()
    assert (r.step, r.total_urls) == ("scraper", 10)
    assert (r.access_success_rate_pct, r.text_extracted_rate_pct, r.keyword_hit_rate_pct, r.extraction_success_rate_pct) == (100.0, 88.89, 75.0, 62.5)


def test_domain_and_cap_specs(spark):
    rows = [("a", "u1", True), ("a", "u2", False), ("b", "u3", True)]
    d = {r.domain: r.accuracy_pct for r in m.domain_accuracy(spark.createDataFrame(rows, "domain string, url string, ok boolean"), "url", "domain", "ok").collect()}
    assert d == {"a": 50.0, "b": 100.0}
    capped = m.domain_cap(spark.createDataFrame([("x", 1), ("y", 2), ("o", 3), ("o", 4), ("z", 5)], "domain string, id int"), "domain", [F.asc("id")], 1)
    assert capped.count() == 4


def test_coverage_spec(spark):
    watch = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "k string, priority boolean")
    c = spark.createDataFrame([("a",), ("c",)], "k string")
    p = spark.createDataFrame([("c",)], "k string")
    r = m.coverage_summary(watch, c, p, "k").first()
    assert (r.hit_pct, r.capture_pct, r.priority_hit_pct) == (66.67, 33.33, 50.0)


def test_integrity_status(spark):
    mt = spark.createDataFrame([("scraper.py", "", 3), ("fb.py", "", 1)], "handled_by string, step_name string, events_written int")
    w = spark.createDataFrame([("scraper",)] * 2 + [("fb",)], "step_name string")
    x = spark.createDataFrame([("fb", False)], "step_name string, reason_registered boolean")
    got = {r.step: r.status for r in m.step_integrity(mt, w, x).collect()}
    assert got == {"scraper": "WARN", "fb": "FAIL"}


def test_crawl_tuning_spec(spark):
    row = [(300, 90, 0, 0, 0, 0, 50, 2, 8, 2, 5000, 15000)]
    t = spark.createDataFrame(row, "requests int, timeouts int, breaker_triggers int, checks int, blocks int, strikes int, timeout_sec int, retries int, concurrency int, per_domain int, wait_min_ms int, wait_max_ms int")
    r = m.crawl_tuning(t).first()
    assert (r.new_timeout_sec, r.new_retries, r.new_concurrency) == (40, 1, 6)


def test_quality_gate_literals(spark):
    rows = [
        ("Dance Country Festival", "2026-05-01", "Warsaw", "d", "s", "u"), ("Salsa Night", "2026-05-01", "somewhere", "d", "s", "u"),
        ("Events", "2026-05-01", "Victoria", "d", "s", "u"), ("Salsa Night", "2026-05-01", "Victoria BC", "d", "s", "u"),
    ]
    df = spark.createDataFrame(rows, "event_name string, start_date string, location string, description string, source string, url string")
    df = df.withColumns({"start_time": F.lit(""), "end_time": F.lit("")})
    reason = gates.quality_reason(("event_name", "location", "description", "source", "url"), social=F.lit(True))
    got = [r.reject_reason for r in df.withColumn("reject_reason", reason).collect()]
    assert got == ["out_of_scope_location", "social_image_missing_locality", "insufficient_event_data", None]
    kept, rejected = gates.split_by_reason(df.withColumn("reject_reason", reason))
    assert kept.count() + rejected.count() == df.count()


def test_upsert_is_idempotent(spark):
    b = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, n int")
    d = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "k long, v string, n int")
    once = maintain.upsert(b, d, ["k"], True)
    twice = maintain.upsert(once, d, ["k"], True)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]


def test_delete_split_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "event_id long, v int")
    kept, audit = maintain.audited_delete(df, F.col("v") > 10, "s", "r", F.lit("t"))
    assert {r.event_id for r in kept.collect()} | {r.event_id for r in audit.collect()} == {1, 2, 3}
    assert [r.event_id for r in audit.collect()] == [3]


def test_in_all_latest_runs(spark):
    df = spark.createDataFrame([(3, "a"), (2, "a"), (1, "a"), (3, "b"), (1, "b"), (0, "c")], "run int, k string")
    assert [r.k for r in sel.in_all_latest_runs(df, "run", "k", 3).collect()] == ["a"]
    assert sel.in_all_latest_runs(df, "run", "k", 9).count() == 0


def test_ical_feed(spark):
    body = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Salsa\\, live\r\nDESCRIPTION:long\r\n  line\\nnext\r\nDTSTART;TZID=X:20260101T190000\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nEND:VEVENT\r\nEND:VCALENDAR"
    rows = rd.explode_ical(spark.createDataFrame([(body,)], "value string")).orderBy("pos").collect()
    assert [(r.uid, r.summary, r.dtstart) for r in rows] == [("1", "Salsa, live", "20260101T190000"), ("2", None, None)]
    assert rows[0].description == "long line\nnext"


def test_seed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source,keywords,link\nHall,\"salsa, tango\",https://a.org\n", encoding="utf-8-sig")
    got = {tuple(r) for r in rd.read_seed_dir(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("Hall", "salsa", "https://a.org"), ("Hall", "tango", "https://a.org")}


def test_publish_refuses_when_gate_fails(spark, tmp_path):
    import pytest

    from curatrix.sources import sinks

    gate = spark.createDataFrame([(False,)], "promote boolean")
    with pytest.raises(RuntimeError):
        sinks.publish_tables(spark, {"t": spark.range(3).toDF("id")}, str(tmp_path / "out"), gate)
    ok = sinks.publish_tables(spark, {"t": spark.range(3).toDF("id")}, str(tmp_path / "out")).first()
    assert (ok.written_rows, ok.expected_rows) == (3, 3)


def test_history_summary_without_runs_in_window(spark):
    h = spark.createDataFrame([(dtm.datetime(2026, 1, 1), 1, 80.0)], "ts timestamp, run_id long, score double")
    got = {r.window: (r.runs, r.delta_latest_vs_avg) for r in m.history_summary(h, F.lit("2026-01-20").cast("date")).collect()}
    assert got == {"7d": (0, 0.0), "30d": (1, 0.0)}
