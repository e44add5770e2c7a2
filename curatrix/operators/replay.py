"""Matching stored rows against a fresh extraction of the same page."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import fuzzy as fz
from ..functions import text as tx
from ..session import written
from .keyed import spread

FIELDS = ("event_name", "start_date", "start_time", "source", "location", "url")


def _norm(df: DataFrame, extra: Sequence[str]) -> DataFrame:
    return df.select(
        *extra, tx.squeeze("event_name").alias("event_name"), F.substring(tx.text("start_date"), 1, 10).alias("start_date"),
        dt.time_norm("start_time").alias("start_time"), tx.squeeze("source").alias("source"), tx.squeeze("location").alias("location"), tx.text("url").alias("url"),
    )


def name_variant(a: Column, b: Column) -> Column:
    """One name contains the other, whole or up to its '@'."""
    left, right = F.trim(F.substring_index(a, "@", 1)), F.trim(F.substring_index(b, "@", 1))
    whole = F.contains(a, b) | F.contains(b, a)
    base = (left != "") & (right != "") & (F.contains(left, right) | F.contains(right, left))
    return (a != "") & (b != "") & (whole | base)


def match_replay(
    base: DataFrame, cand: DataFrame, status: DataFrame | None = None, strict_time: bool = True, similarity: Callable = fz.sequence_ratio,
    social: Callable[[Column], Column] | None = None, calendar: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(base_id, cand_id, is_match, category): the best candidate of each row's page and how it differs.

    ``base``: base_id and FIELDS. ``cand``: cand_id, page_url (the page that was read) and
    FIELDS. ``status``: page_url, ok, category for pages that could not be read. Equal
    candidates of a page are compared once (with their count), and names are scored as
    distinct pairs. Of rows with one base_id each gets the best candidate of its own page.
    """
    social = social or (lambda c: F.lower(c).rlike(r"(facebook|instagram)\.com"))
    calendar = calendar or (lambda c: F.lower(c).rlike(r"calendar\.google\.com|google\.com/calendar|group\.calendar\.google\.com|/calendar/ical/"))
    b = _norm(base, ["base_id"])
    c = _norm(cand, ["cand_id", "page_url"]).groupBy("page_url", *FIELDS).agg(F.min("cand_id").alias("cand_id"), F.count(F.lit(1)).alias("copies"))
    c = c.select("page_url", "cand_id", "copies", *[F.col(f).alias(f"c_{f}") for f in FIELDS])
    pairs = b.join(c, b["url"] == c["page_url"])
    names = spread(pairs.select("event_name", "c_event_name"), "event_name", "c_event_name").distinct()
    # few names stand in many pairs: with files of a known size they are sent to the pairs, not the pairs to them
    names = written(names.withColumn("sim", similarity(F.col("event_name"), F.col("c_event_name"))))
    n = names.select(F.col("event_name").alias("_ne"), F.col("c_event_name").alias("_nc"), "sim")
    p = pairs.join(n, (pairs["event_name"] == n["_ne"]) & (pairs["c_event_name"] == n["_nc"])).drop("_ne", "_nc")
    same = {f: F.col(f) == F.col(f"c_{f}") for f in FIELDS}
    time_ok = dt.times_equal_12h("c_start_time", "start_time")
    p = p.withColumns({
        "variant": name_variant(F.col("event_name"), F.col("c_event_name")), "same_page": same["url"], "same_date": same["start_date"], "time_ok": time_ok,
        "score": F.when(same["event_name"], 4).otherwise(0) + F.when(same["start_date"], 4).otherwise(0) + F.when(same["url"], 3).otherwise(0)
        + F.when(same["source"], 2).otherwise(0) + F.when(same["start_time"] & (F.col("start_time") != ""), 2).otherwise(0),
        "identical": same["event_name"] & same["start_date"] & same["start_time"],
    })
    # pool flags need page-level facts, so rank keys are built for every case and picked after
    strong = (F.col("sim") >= 0.75) | F.col("variant")
    dated = F.col("same_page") & F.col("same_date")

    def best(cond, out):
        return F.max_by(F.when(cond, F.struct("cand_id", *[f"c_{f}" for f in FIELDS], "sim", "variant", "time_ok")), F.when(cond, F.struct("score", -F.col("cand_id")))).alias(out)

    # the url, by which the pairs were met, is a key too, so they stay where they are
    agg = p.groupBy("url", "base_id").agg(
        F.sum("copies").alias("n"), F.sum(F.when(F.col("same_page"), F.col("copies"))).alias("n_page"), F.max(dated.cast("int")).alias("has_date"),
        F.sum(F.when(F.col("identical"), F.col("copies"))).alias("n_identical"), F.max("sim").alias("top_sim"), F.bool_or("variant").alias("any_variant"),
        best(F.lit(True), "b_all"), best(dated & strong, "b_ds"), best(dated & F.col("time_ok"), "b_dt"), best(dated, "b_d"),
        best(F.col("same_page") & strong, "b_ps"), best(F.col("same_page") & F.col("time_ok"), "b_pt"), best(F.col("same_page"), "b_p"),
    )
    pick = F.when(F.col("n_page") > 1, F.when(F.col("has_date") == 1, F.coalesce("b_ds", "b_dt", "b_d")).otherwise(F.coalesce("b_ps", "b_pt", "b_p"))).otherwise(F.col("b_all"))
    chosen = agg.select(F.col("base_id").alias("_bid"), F.col("url").alias("_burl"), "n", "n_identical", "top_sim", "any_variant", pick.alias("r"))
    j = b.join(chosen, (b["base_id"] == chosen["_bid"]) & (b["url"] == chosen["_burl"]), "left")
    if status is not None:
        s = status.filter(~F.col("ok")).select(F.col("page_url").alias("_su"), F.coalesce("category", F.lit("parser_or_llm_failure")).alias("_sc"))
        j = j.join(s, j["url"] == s["_su"], "left")
    else:
        j = j.withColumn("_sc", F.lit(None).cast("string"))
    r = {f: F.col(f"r.c_{f}") for f in FIELDS}
    on_date, on_url, on_time = r["start_date"] == F.col("start_date"), r["url"] == F.col("url"), F.col("r.time_ok")
    gap = F.abs(F.datediff(r["start_date"].try_cast("date"), F.col("start_date").try_cast("date")))
    recurring = (
        on_url & social(F.col("url")) & (F.col("event_name") != "") & (r["event_name"] == F.col("event_name")) & on_time & gap.between(1, 35) & (gap % 7 == 0)
        & (dt.has_recurrence("event_name") | (F.col("event_name") == "live music"))
    )
    core = on_url & on_date & ((F.col("r.sim") >= 0.90) | F.col("r.variant"))
    if strict_time:
        core = core & on_time
    wrong_time = (r["start_time"] != F.col("start_time")) if strict_time else F.lit(False)
    steps = [
        (F.col("url") == "", "missing_url_baseline"), (calendar(F.col("url")), ""), (F.col("_sc").isNotNull(), F.col("_sc")),
        (F.col("r").isNull(), "no_event_extracted_replay"), (social(F.col("url")) & ~on_url, "wrong_replay_source_url"), (F.coalesce(recurring, F.lit(False)), ""),
        (F.col("n_identical") > 1, "duplicate_event_identity"),
        ((F.col("n") > 1) & on_url & on_date & (F.col("top_sim") < 0.60) & ~F.col("any_variant"), "wrong_replay_event_selection"),
        (core, ""), (~on_date, "wrong_date"), (wrong_time, "wrong_time"),
        ((F.col("location") != "") & (r["location"] != "") & (r["location"] != F.col("location")), "wrong_location_or_address"),
        ((r["source"] != F.col("source")) & ~tx.is_placeholder_source(r["source"]) & ~tx.is_placeholder_source("source"), "wrong_source"),
        (F.col("r.sim") < 0.60, "content_drift_major"),
    ]
    category = F.lit("other_mismatch")
    for cond, name in reversed(steps):
        category = F.when(cond, F.lit(name) if isinstance(name, str) else name).otherwise(category)
    return j.withColumn("category", category).select("base_id", F.col("r.cand_id").alias("cand_id"), (F.col("category") == "").alias("is_match"), "category")
