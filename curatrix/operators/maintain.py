"""Table maintenance as functions from old tables to new ones; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .keyed import global_rank, latest_per_key


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by the other columns in their order."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], keep_old_on_null: bool = False) -> DataFrame:
    """Insert or overwrite by key. ``keep_old_on_null`` keeps the stored value where the new one is NULL.

    Of several delta rows for one key the greatest by all other columns counts.
    """
    delta = one_per_key(delta, keys)
    d = delta.select(*[F.col(c).alias(f"_d_{c}") for c in delta.columns]).withColumn("_new", F.lit(True))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (base[k] == d[f"_d_{k}"])
    j = base.join(d, cond, "full_outer")
    out = []
    for c in base.columns:
        if c not in delta.columns:
            out.append(F.col(c))
        elif keep_old_on_null or c in keys:
            out.append(F.coalesce(f"_d_{c}", c).alias(c))
        else:
            out.append(F.when(F.col("_new"), F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c))
    return j.select(*out)


def insert_ignore(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose key is absent; one row per new key (the first by all columns)."""
    fresh = delta.join(base.select(*keys), list(keys), "left_anti")
    rest = [c for c in delta.columns if c not in keys]
    if rest:
        fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return base.unionByName(fresh.select(*base.columns))


def audited_delete(df: DataFrame, victim: Column, source: str, reason: str, deleted_at: Column, context: dict[str, str] | None = None):
    """Split into (kept, audit). The audit keeps the whole row as JSON next to source and reason."""
    gone = F.coalesce(victim, F.lit(False))
    kept = df.filter(~gone)
    audit = df.filter(gone).select(
        F.col("event_id"), deleted_at.alias("deleted_at"), F.lit(source).alias("deletion_source"), F.lit(reason).alias("deletion_reason"),
        F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in (context or {"": ""}).items() if k])) if context else F.lit("{}").alias("extra_context"),
        F.to_json(F.struct(*df.columns)).alias("event_json"),
    )
    return kept, audit


def delete_attribution(audit: DataFrame, writes: DataFrame, run_id: str, step: str) -> DataFrame:
    """One attribution row per delete: this run and step, the step that wrote the row, and the reason code."""
    from .normalize import delete_reason_code

    w = writes.select(F.col("event_id").alias("_w"), F.col("step_name").alias("created_by_step"))
    code = delete_reason_code("deletion_reason")
    return audit.join(w, audit["event_id"] == w["_w"], "left").select(
        "event_id", F.lit(run_id).alias("run_id"), F.lit(step).alias("step_name"), "created_by_step",
        code["code"].alias("delete_reason_code"), code["registered"].alias("reason_registered"),
    )


def write_attribution(inserted: DataFrame, run_id: Column, step: Column, method: Column) -> DataFrame:
    return inserted.select("event_id", run_id.alias("run_id"), step.alias("step_name"), method.alias("write_method"))


def append_with_ids(base: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Append ``rows`` with ids after the largest stored one, numbered in a repeatable order."""
    top = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    ranked = global_rank(rows, order, "_rank")
    numbered = ranked.join(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("_rank")).drop("_top", "_rank")
    return base.unionByName(numbered.select(*base.columns))


def snapshot_history(events: DataFrame, history: DataFrame) -> DataFrame:
    """History plus the current table, which keeps its ids as original_event_id."""
    return history.unionByName(events.withColumn("original_event_id", F.col("event_id")), allowMissingColumns=True)


def latest_delete(audit: DataFrame, key: str = "event_id", stamp: str = "deleted_at") -> DataFrame:
    """Newest audit row per event; rows without an id are all kept."""
    rest = [c for c in audit.columns if c != stamp]
    known = latest_per_key(audit.filter(F.col(key).isNotNull()), [key], [stamp] + [c for c in rest if c != key][:1])
    return known.unionByName(audit.filter(F.col(key).isNull()))


def restore_deleted(audit: DataFrame, base: DataFrame, wanted: Column, schema: str) -> DataFrame:
    """Put the newest deleted version of the wanted events back where they are missing."""
    rows = latest_delete(audit.filter(wanted)).select(F.from_json("event_json", schema).alias("e")).select("e.*")
    return insert_ignore(base, rows.select(*base.columns), ["event_id"])


def overlay(base: DataFrame, delta: DataFrame, keys: Sequence[str], always: Iterable[str] = ("url",)) -> DataFrame:
    """Non-blank new values over the row found by key; ``always`` columns are replaced even by blanks.

    Of several delta rows for one key the greatest by all other columns counts.
    """
    delta = one_per_key(delta, keys)
    d = delta.select(*[F.col(c).alias(f"_d_{c}") for c in delta.columns]).withColumn("_hit", F.lit(True))
    cond = F.lit(True)
    for k in keys:
        cond = cond & base[k].eqNullSafe(d[f"_d_{k}"])
    j = base.join(d, cond, "left")
    out = []
    for c in base.columns:
        new = f"_d_{c}"
        if c in keys or c not in delta.columns:
            out.append(F.col(c))
        elif c in always:
            out.append(F.when(F.col("_hit"), F.col(new)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(~tx.blank(new), F.col(new)).otherwise(F.col(c)).alias(c))
    return j.select(*out)


def expire_sessions(messages: DataFrame, conversation: str, stamp: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the conversations that were active within ``days`` of ``as_of``."""
    alive = messages.groupBy(conversation).agg(F.max(stamp).alias("_last")).filter(
        F.col("_last") >= F.date_sub(as_of, days).cast("timestamp_ntz")
    ).select(F.col(conversation).alias("_c"))
    return messages.join(alive, messages[conversation] == alive["_c"], "left_semi")


def renumber(dim: DataFrame, key: str) -> DataFrame:
    """(old, new): dense ids 1..n in key order."""
    return global_rank(dim.select(F.col(key).alias("old")).distinct(), ["old"], "new")


def repoint(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Replace a foreign key by its new value; unknown keys stay."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return df.join(m, df[key] == m["_old"], "left").withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")


def sync_window(source: DataFrame, target: DataFrame, stamp: str, keys: Sequence[str], days: int, as_of: Column) -> DataFrame:
    """Upsert the last ``days`` of source rows into the target."""
    return upsert(target, source.filter(F.col(stamp) >= F.date_sub(as_of, days).cast("timestamp_ntz")), keys)




def write_method(prompt: str, url: str, parent: str) -> Column:
    """How a row was extracted, when not given: vision prompt, calendar URL, else model."""
    both = F.lower(F.concat_ws(" ", tx.text(url), tx.text(parent)))
    return (
        F.when(F.lower(tx.text(prompt)) == "vision_extraction", "vision_extraction")
        .when(both.contains("calendar"), "google_calendar_fetch").otherwise("llm_extraction")
    )
