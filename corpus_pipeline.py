"""Corpus pipeline over ``documents``: toxicity, copies, near copies, benchmark passages, tokens.

Each stage reads the rows that its predecessor kept, decides by one operator, and hands on
the rows that stay with all columns of ``documents``; the last one returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import decontam, exact, minhash, pieces, toxicity
from curatrix.llm.common import SPACES, small_side, stored

#: The model stage has no SQL form; tests/llm compares the pipeline with a plain version.
ORACLE_SQL = None


def keep(docs: DataFrame, text_key: Column, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text key are among ``doc_id``, ``key`` of ``verdicts``.

    Where ``single`` is set, one row of those with that id and key stays: the least of them
    as JSON text. Null ids equal one another. No verdicts give no rows. Columns of any name
    and type pass through.
    """
    wanted = small_side(stored(verdicts.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), "single").distinct(), "kept"))
    # the row goes along as one struct, so that none of its columns can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_key.alias("key"))
    met = rows.join(wanted, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    counts = met.filter("single").groupBy(F.col("id").alias("many_id"), F.col("key").alias("many_key")).agg(F.count(F.lit(1)).alias("n"))
    many = stored(counts.filter("n > 1").select("many_id", "many_key"), "repeated")
    if many.isEmpty():
        return met.select("row.*")
    same = F.col("id").eqNullSafe(F.col("many_id")) & (F.col("key") == F.col("many_key"))
    once = met.join(small_side(many), same, "left_anti").select("row")
    # maps have no order, their JSON text does
    least = met.join(small_side(many), same, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(least.select("row")).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; row by row, so repeated rows and null ids are judged alike, and a null text as an empty one."""
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return scored.filter("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts; null is an empty text, null ids come last, and of rows with one id and text one stays."""
    first = exact.exact_duplicates(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("key"), F.lit(True).alias("single"))
    return keep(docs, F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "), 256), first)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies (five-word shingles, 0.8); texts without words are copies of nothing and stay."""
    kept = stored(minhash.near_duplicates(docs, rows=True).filter("kept").select("doc_id", "row", "component"), "verdicts")
    one = kept.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("m.doc_id", F.col("m.row").alias("key"), F.lit(True).alias("single"))
    alone = kept.filter("component is null").select("doc_id", F.col("row").alias("key"), F.lit(False).alias("single"))
    return keep(docs, F.xxhash64("text"), one.unionByName(alone))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null and empty texts have none and stay."""
    marked = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return marked.filter("not contaminated").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row that is left; a null or empty text has none."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
