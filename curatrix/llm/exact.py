"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, id_and_text, stored

BLOCK_CHARS = 8192


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hash_mask: int = -1) -> DataFrame:
    """Groups of documents whose texts agree after white space runs become one space.

    Every text is cut into blocks of ``block_chars`` characters. The distinct blocks are
    sorted into integer names; then the distinct pairs of adjacent names are sorted into
    names of the next level, until each document has one name. Equal names mean equal
    texts: blocks are sorted by (hash, text), so two blocks with one hash keep apart.
    Only that first sort moves texts; occurrences find their block's name by its hash.

    Returns one row per document: ``doc_id``, ``keep_id`` (smallest id of the group),
    ``group_size``, ``kept``, ``text_sha256`` (of the normalised text).

    * A null text counts as empty; empty texts are equal to each other.
    * Rows repeated under one id with equal texts are one document; with different
      texts they are several documents of that id.
    * A null id is returned as null, never becomes a ``keep_id`` unless the whole group
      has no id, and is not kept when another member has one.
    * An empty table gives an empty result. Other columns are ignored.

    ``hash_mask`` narrows the hash so that tests can provoke equal hashes.
    """
    leaves = _blocks(docs, id_col, text_col, block_chars, hash_mask)
    names = _block_names(leaves)
    occurrences = leaves.drop("block").join(names.filter("variants = 1").select("hash", "name"), "hash").select("doc_id", "text_sha256", "n", "seq", "name")
    clashes = names.filter("variants > 1").select("hash", "name")
    if not clashes.isEmpty():
        occurrences = occurrences.unionByName(_clashing(leaves, clashes))
    level, current = 0, stored(occurrences, "blocks")
    ended = current.filter("n = 1").select("doc_id", "text_sha256", F.lit(0).alias("level"), "name").distinct()
    longest = current.agg(F.max("n")).first()[0] or 0
    while longest > 1:
        level += 1
        current = stored(_next_level(current.filter("n > 1")), "blocks")
        ended = ended.unionByName(current.filter("n = 1").select("doc_id", "text_sha256", F.lit(level).alias("level"), "name"))
        longest = (longest + 1) // 2
    groups = stored(ended.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ended.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _blocks(docs, id_col, text_col, block_chars, hash_mask) -> DataFrame:
    """(doc_id, text_sha256, n blocks, seq, block, hash); an empty text is one empty block."""
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ").alias("text"))
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    parts = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), cut.alias("parts"))
    rows = parts.select("doc_id", "text_sha256", F.size("parts").alias("n"), F.posexplode("parts").alias("seq", "block"))
    return rows.withColumn("hash", F.xxhash64("block").bitwiseAND(F.lit(hash_mask).cast("long")))


def _block_names(leaves: DataFrame) -> DataFrame:
    """(hash, variants, name): position of each hash in the sorted distinct blocks."""
    distinct = leaves.groupBy("hash", "block").agg(F.count(F.lit(1)).alias("_n"))
    hashes = distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("variants"))
    return stored(hashes.orderBy("hash").withColumn("name", F.monotonically_increasing_id() * 2), "names")


def _clashing(leaves: DataFrame, clashes: DataFrame) -> DataFrame:
    """Occurrences of blocks that share a hash with another block, told apart by their text.

    Names are even positions doubled; a further variant takes an odd number made from
    the position and its rank, which no other block can have.
    """
    rows = leaves.join(clashes, "hash")
    ranks = rows.groupBy("hash", "name", "block").agg(F.count(F.lit(1)).alias("_n"))
    ranks = ranks.withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("block")) - 1)
    ranks = stored(ranks.select("hash", "block", "name", "rank"), "variants")
    spread = stored(ranks.filter("rank > 0").orderBy("hash", "rank").select("hash", "block", (F.monotonically_increasing_id() * 2 + 1).alias("name")), "variants")
    named = ranks.filter("rank = 0").select("hash", "block", "name").unionByName(spread)
    return leaves.join(named, ["hash", "block"]).select("doc_id", "text_sha256", "n", "seq", "name")


def _next_level(current: DataFrame) -> DataFrame:
    """Names of adjacent pairs; a last name without partner is paired with -1."""
    pairs = current.groupBy("doc_id", "text_sha256", "n", F.floor(F.col("seq") / 2).cast("int").alias("seq")).agg(
        F.max(F.when(F.col("seq") % 2 == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(F.col("seq") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
    )
    pairs = stored(pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int")), "pairs")
    names = pairs.select("left", "right").distinct().orderBy("left", "right").withColumn("name", F.monotonically_increasing_id())
    names = stored(names, "names")
    return pairs.join(names, ["left", "right"]).select("doc_id", "text_sha256", "n", "seq", "name")
