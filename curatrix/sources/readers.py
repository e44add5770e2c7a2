"""Scans of the tables, feeds, logs and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as dt
from ..functions import text as tx
from .schemas import DELETE_AUDIT_SCHEMA, EVENT_SCHEMA


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Typed scan of the event table; schema is given, never inferred."""
    return spark.read.format(fmt).schema(EVENT_SCHEMA).options(**options).load(path)


def read_events_jdbc(spark: SparkSession, url: str, table: str, partitions: int, low: int, high: int, **options) -> DataFrame:
    """Event table over JDBC, read in parallel slices of event_id."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", "event_id")
        .option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions).options(**options).load()
    )


def read_seed_dir(spark: SparkSession, glob: str) -> DataFrame:
    """source, keyword, link of every seed CSV; header row, byte-order mark and blanks handled."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").schema("source string, keywords string, link string").option("enforceSchema", True).csv(glob)
    return explode_seeds(raw)


def explode_seeds(raw: DataFrame) -> DataFrame:
    """One row per seed link and keyword."""
    bare = raw.withColumn("source", F.regexp_replace(tx.text("source"), "^\ufeff", ""))
    words = F.split(F.regexp_replace(tx.text("keywords"), r"\s*,\s*", ","), ",")
    return bare.filter(~tx.blank("link")).select("source", F.explode(words).alias("keyword"), tx.text("link").alias("link")).distinct()


def read_delete_audit(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines audit of deleted rows; corrupt lines are dropped."""
    return parse_delete_audit(spark.read.text(path))


def parse_delete_audit(lines: DataFrame, schema: T.StructType = DELETE_AUDIT_SCHEMA) -> DataFrame:
    parsed = lines.filter(F.trim("value") != "").select(
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("j")
    ).filter(F.col("j").isNotNull() & F.col("j.corrupt").isNull())
    return parsed.select("j.*").drop("corrupt")


# Markers of log lines.
OUTCOMES = {"success": "response received", "failure": "query failed", "timeout": "timed out", "rate_limit": "too many requests|status 429|rate limit exceeded"}


def parse_step_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """ts, run_id, step, provider, model, is_query and outcome of each log line."""
    c = F.col(column)
    ts = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    low = F.lower(c)
    outcome = F.lit(None).cast("string")
    for name, pattern in reversed(OUTCOMES.items()):
        outcome = F.when(low.rlike(pattern), name).otherwise(outcome)
    provider = F.regexp_extract(low, r"query_llm\(\): (\w+) (?:response|query)", 1)
    asked = F.regexp_extract(low, r"querying (\w+)(?: model[= ]([\w.:/-]+))?", 1)
    return lines.select(
        dt.parse_event_ts(ts).alias("ts"), F.regexp_extract(c, r"\[run_id=([^\]]+)\]", 1).alias("run_id"), F.regexp_extract(c, r"\[step=([^\]]+)\]", 1).alias("step"),
        F.when(asked != "", asked).otherwise(provider).alias("provider"), F.regexp_extract(low, r"querying \w+ model[= ]([\w.:/-]+)", 1).alias("model"),
        (asked != "").alias("is_query"), outcome.alias("outcome"), c.alias("line"),
    )


def latest_run_slice(log: DataFrame, step: str | None = None) -> DataFrame:
    """Lines of each step's newest run (of one step when given)."""
    own = log.filter((F.col("run_id") != "") & (F.col("step") != ""))
    if step:
        own = own.filter(F.col("step") == step)
    last = own.groupBy("step").agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id"))
    return own.join(last, ["step", "run_id"], "left_semi")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path).select("page_id", "url", "html")


ICAL_FIELDS = ("UID", "SUMMARY", "DTSTART", "DTEND", "DESCRIPTION", "LOCATION", "URL")


def explode_ical(feeds: DataFrame, body: str = "value") -> DataFrame:
    """One row per VEVENT of each iCalendar feed, with seven properties unescaped.

    Folded lines are joined, the feed is cut at its event blocks and each property is one
    pattern on its block, all in the JVM.
    """
    unfolded = F.regexp_replace(F.regexp_replace(F.col(body), "\r\n?", "\n"), "\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?s)(?:^|\n)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), F.lit(1))
    rest = [c for c in feeds.columns if c != body]
    exploded = feeds.select(*rest, F.posexplode(blocks).alias("pos", "_b"))

    def prop(name):
        raw = F.regexp_extract("_b", rf"(?mi)^{name}(?:;[^:\n]*)?:(.*)$", 1)
        clean = F.replace(F.replace(F.replace(raw, F.lit("\\n"), F.lit("\n")), F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";"))
        return F.nullif(F.trim(clean), F.lit("")).alias(name.lower())

    return exploded.select(*rest, "pos", *[prop(f) for f in ICAL_FIELDS])


# Words of calendar entries and the event type they mean, first hit wins.
CALENDAR_TYPES = (
    ("class", "class"), ("classes", "class"), ("dance", "social dance"), ("dancing", "social dance"), ("weekend", "workshop"),
    ("workshop", "workshop"), ("rehearsal", "rehearsal"),
)


def flatten_calendar(items: DataFrame, item: str = "item") -> DataFrame:
    """Event rows from nested calendar items (htmlLink, summary, location, description, start, end)."""
    c = F.col
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(f"{item}.description", F.lit("")), "<[^>]*>", " "), r"\s{2,}", " "))
    clean = F.replace(F.replace(clean, F.lit("&#39;"), F.lit("'")), F.lit("you're"), F.lit("you are"))
    start = F.coalesce(f"{item}.start.dateTime", f"{item}.start.date")
    end = F.coalesce(f"{item}.end.dateTime", f"{item}.end.date")
    both = F.lower(F.concat_ws(" ", f"{item}.summary", clean))
    kind = F.lit("other")
    for word, value in reversed(CALENDAR_TYPES):
        kind = F.when(both.contains(word), value).otherwise(kind)
    kind = F.when(both.contains("class") & both.contains("dance"), "class, social dance").otherwise(kind)

    def time_of(stamp: Column) -> Column:
        return F.when(stamp.contains("T"), F.substring(F.substring_index(stamp, "T", -1), 1, 8))

    day = F.substring_index(start, "T", 1).try_cast("date")
    return items.select(
        *[x for x in items.columns if x != item], c(f"{item}.htmlLink").alias("url"), kind.alias("event_type"), c(f"{item}.summary").alias("event_name"),
        dt.weekday_name(day).alias("day_of_week"), day.alias("start_date"), F.substring_index(end, "T", 1).try_cast("date").alias("end_date"),
        time_of(start).alias("start_time"), time_of(end).alias("end_time"),
        F.regexp_extract(F.coalesce(f"{item}.description", F.lit("")), r"\$(\d{1,5})", 1).try_cast("int").alias("price"),
        c(f"{item}.location").alias("location"), clean.alias("description"),
    )
