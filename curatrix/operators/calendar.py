"""Date repairs on event rows. Times of day are integer seconds; 'now' is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import text as tx
from ..functions import urls as u
from .keyed import top_by_limit, with_group_agg


def roll_overnight(df: DataFrame) -> DataFrame:
    """End date one day later where the row ends before it starts on the same day."""
    rolls = (
        F.coalesce("end_date", "start_date").eqNullSafe(F.col("start_date")) & (F.col("end_sec") < F.col("start_sec"))
    )
    return df.withColumn("end_date", F.when(rolls, F.date_add("start_date", 1)).otherwise(F.col("end_date")))


def repair_weekday(df: DataFrame) -> DataFrame:
    """Rows whose weekday is missing, invalid or different from start_date, with the right name."""
    right = dt.weekday_name("start_date")
    stored = dt.clean_weekday("day_of_week")
    return df.filter(F.col("start_date").isNotNull() & ~stored.eqNullSafe(right)).withColumn("day_of_week", right)


def align_recurring(df: DataFrame) -> DataFrame:
    """Move recurring rows to the nearest stated weekday.

    A row recurs when its text says so or its (name, time, source, weekday) group has
    more than one row.
    """
    keyed = df.withColumns({
        "_n": F.lower(tx.text("event_name")), "_t": F.coalesce("start_sec", F.lit(-1)),
        "_s": F.lower(tx.text("source")), "_w": F.lower(tx.text("day_of_week")),
    })
    sized = with_group_agg(keyed, ["_n", "_t", "_s", "_w"], _size=F.count(F.lit(1)))
    recurs = dt.has_recurrence("event_name", "description", "location") | (F.col("_size") > 1)
    shift = F.when(
        F.col("start_date").isNotNull() & (F.col("_w") != "") & recurs,
        dt.nearest_weekday_shift("start_date", "day_of_week"),
    ).otherwise(0)
    return sized.withColumn("_shift", shift).withColumns({
        "start_date": F.date_add("start_date", F.col("_shift")),
        "end_date": F.date_add("end_date", F.col("_shift")),
    }).drop("_n", "_t", "_s", "_w", "_size", "_shift")


def prewrite_dates(df: DataFrame) -> DataFrame:
    """Fill start from end, resolve relative weekdays, fall back to a date in the URL, drop dateless rows."""
    start = F.coalesce("start_date", "end_date")
    relative = F.lower(tx.text("day_of_week")).isin(*dt.RELATIVE_WEEKDAYS)
    day = F.when(relative, F.coalesce(dt.weekday_name(start), F.lit(""))).otherwise(tx.text("day_of_week"))
    fallback = u.url_date("url")
    return (
        df.withColumns({
            "_day": F.when(start.isNull() & (day == ""), F.coalesce(dt.weekday_name(fallback), F.lit(""))).otherwise(day),
            "_start": F.coalesce(start, fallback),
        })
        .withColumns({"day_of_week": F.col("_day"), "start_date": F.col("_start")})
        .drop("_day", "_start")
        .filter(F.col("start_date").isNotNull())
    )


def header_date_override(df: DataFrame, body: str, applies: Column | None = None) -> DataFrame:
    """An absolute date in the page header wins over the row's date and sets the weekday."""
    found = dt.header_date(body)
    if applies is not None:
        found = F.when(applies, found)
    return df.withColumn("_h", found).withColumns({
        "start_date": F.coalesce("_h", "start_date"),
        "day_of_week": F.coalesce(dt.weekday_name("_h"), "day_of_week"),
    }).drop("_h")


def expand_schedule(df: DataFrame, poster: str, pos: str, dates: str) -> DataFrame:
    """Spread the dates of a schedule poster over its rows.

    A poster with one row and several dates gives one row per date. With several rows,
    rows are visited in order: a row whose date is on the list uses that date up, any
    other row takes the first unused date. Only the first use of each date and the
    first rows without a listed date can matter, so what is folded per poster is
    bounded by the length of its date list, however many rows it has.
    """
    sized = with_group_agg(df, [poster], _rows=F.count(F.lit(1)))
    single = (F.col("_rows") == 1) & (F.size(dates) > 1)
    cloned = (
        sized.filter(single)
        .withColumn("_d", F.explode(dates))
        .withColumns({"start_date": F.col("_d"), "end_date": F.col("_d"), "day_of_week": dt.weekday_name("_d")})
        .drop("_d", "_rows")
    )
    many = sized.filter(~single).withColumn("_listed", F.coalesce(F.array_contains(dates, F.col("start_date")), F.lit(False)))
    first_use = (
        many.filter("_listed").groupBy(poster, "start_date").agg(F.min(pos).alias("_p"), F.first(dates).alias("_dates"))
        .select(poster, "_p", F.col("start_date").alias("_use"), "_dates")
    )
    takers = (
        top_by_limit(many.filter(~F.col("_listed")), [poster], F.size(dates), [F.asc(pos)], F.col(pos), "_rn")
        .select(poster, F.col(pos).alias("_p"), F.lit(None).cast("date").alias("_use"), F.col(dates).alias("_dates"))
    )
    steps = first_use.unionByName(takers).groupBy(poster).agg(
        F.array_sort(F.collect_list(F.struct("_p", "_use"))).alias("_steps"), F.first("_dates").alias("_dates")
    )
    start = F.struct(
        F.col("_dates").alias("left"), F.array().cast("array<struct<p:bigint,d:date>>").alias("given")
    )

    def step(state, s):
        head = F.get(state["left"], F.lit(0))
        takes = s["_use"].isNull() & head.isNotNull()
        return F.struct(
            F.when(s["_use"].isNotNull(), F.array_remove(state["left"], F.coalesce(s["_use"], F.lit("0001-01-01").cast("date"))))
            .when(takes, F.slice(state["left"], 2, F.greatest(F.size(state["left"]), F.lit(1)))).otherwise(state["left"]).alias("left"),
            F.when(takes, F.concat(state["given"], F.array(F.struct(s["_p"].cast("bigint").alias("p"), head.alias("d")))))
            .otherwise(state["given"]).alias("given"),
        )

    given = steps.select(
        F.col(poster).alias("_poster"), F.explode(F.aggregate("_steps", start, step)["given"]).alias("_g")
    ).select("_poster", F.col("_g.p").alias("_pos"), F.col("_g.d").alias("_given"))
    assigned = many.join(given, (many[poster] == given["_poster"]) & (many[pos] == given["_pos"]), "left")
    listed_day = F.when(tx.blank("day_of_week"), dt.weekday_name("start_date")).otherwise(F.col("day_of_week"))
    spread = assigned.withColumns({
        "start_date": F.coalesce("_given", "start_date"),
        "end_date": F.when(F.col("_given").isNotNull(), F.col("_given"))
        .when(F.col("_listed"), F.coalesce("end_date", "start_date")).otherwise(F.col("end_date")),
        "day_of_week": F.when(F.col("_given").isNotNull(), dt.weekday_name("_given"))
        .when(F.col("_listed"), listed_day).otherwise(F.col("day_of_week")),
    }).drop("_poster", "_pos", "_given", "_listed", "_rows")
    return cloned.unionByName(spread)


def resolve_date_conflict(df: DataFrame, detected: str, detected_day: str) -> DataFrame:
    """Score the row's date against a detected date; adds action, resolved_date, reason.

    Fixed weights: 4 for the stored date, 2 for the detected one, +3/-5 for (dis)agreeing
    weekdays, +2 for recurrence, +1 when the dates are within a week; 4 points are
    needed to replace, 2 to keep.
    """
    row_date, found = F.col("start_date"), F.col(detected)
    row_day, found_day = F.lower(tx.text("day_of_week")), F.lower(tx.text(detected_day))
    recurs = F.lower(F.concat_ws(" ", tx.text("event_name"), tx.text("description"))).rlike(
        r"\b(every|weekly|recurs?|monthly|first|second|third|fourth|fifth)\b"
    )
    date_day = F.lower(dt.weekday_name(row_date))
    stored_score = (
        F.lit(4)
        + F.when(row_day == "", 0).when(row_day == date_day, 3).otherwise(-5)
        + F.when(recurs, 2).otherwise(0)
        + F.when(F.abs(F.datediff(row_date, found)) <= 7, 1).otherwise(0)
    )
    found_score = F.lit(2) + F.when((row_day == "") | (found_day == ""), 0).when(row_day == found_day, 3).otherwise(-5)
    same_day = (row_day != "") & (row_day == found_day) & ~recurs
    action = (
        F.when(found.isNull(), "keep_existing")
        .when(row_date.isNull(), "fill_detected")
        .when(row_date == found, "keep_existing")
        .when(same_day, "drop_ambiguous")
        .when(found_score >= stored_score + 4, "replace_with_detected")
        .when(stored_score >= found_score + 2, "keep_existing")
        .otherwise("drop_ambiguous")
    )
    return df.withColumn("action", action).withColumn(
        "resolved_date",
        F.when(F.col("action").isin("fill_detected", "replace_with_detected"), found)
        .when(F.col("action") == "keep_existing", row_date),
    )


def expand_recurring(rules: DataFrame, as_of: Column, weeks: int = 1) -> DataFrame:
    """One row per occurrence of weekly rules (weekday, include_today) from ``as_of`` on."""
    ahead = F.pmod(dt.weekday_index("weekday") - F.weekday(as_of), F.lit(7))
    first = F.date_add(as_of, F.when((ahead == 0) & ~F.col("include_today"), 7).otherwise(ahead).cast("int"))
    days = F.sequence(first, F.date_add(first, 7 * (weeks - 1)), F.expr("interval 7 days"))
    return (
        rules.filter(dt.weekday_index("weekday").isNotNull())
        .withColumn("start_date", F.explode(days))
        .withColumn("end_date", F.col("start_date"))
    )
