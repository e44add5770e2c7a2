"""Phrases whose words stand together more often than apart, from count streams in prefix and suffix order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stored
from .repeats import _bit_filter, in_filter
from .wordhash import mixed, slice_hashes

MIN_COUNT, COVER, TOP = 10, 50, 2000
#: Bytes of text that are named at once, and words that are counted at once.
PIECE_BYTES, HELD_WORDS = 1 << 20, 1 << 21
#: Largest filter of frequent pairs that each task holds.
FILTER_BYTES = 64 << 20
#: Groups that a language's candidates are ranked in, step by step.
SALTS = (512, 8, 1)
GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)
KIND[list(GAPS)] = 1
KIND[list(BREAKS)] = 2
PAIR = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of many texts: their names, the pieces they stand in, and where their bytes are.

    The name of a word is a 64-bit hash of its language and its lower-cased bytes, so all
    tasks agree on names without a dictionary; ``vocabulary`` proves that no two share one.
    """

    def __init__(self, salt: int):
        self.salt = salt
        spread = np.arange(1, 257, dtype=np.uint64)[LOWER]
        self.values = mixed(spread * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt))
        self.others = mixed(spread * np.uint64(0xA0761D6478BD642F) + np.uint64(salt))

    def __call__(self, texts: list[bytes], langs: list[str], second: bool = False) -> tuple:
        """(names, pieces, text numbers, second hashes, data, begins, ends) of the words of ``texts``."""
        data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        kind = KIND[data]
        word = kind == 0
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        begin, end = edges[0::2], edges[1::2]
        pieces = np.cumsum(kind == 2)[begin]
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="left")
        of_lang = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), self.salt) for x in langs], np.uint64)
        names = mixed(slice_hashes(self.values[data], begin, end) + of_lang[text])
        check = slice_hashes(self.others[data], begin, end) if second else None
        return names, pieces, text, check, data, begin, end


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and languages of a batch, in slices of bounded bytes or one text."""
    texts, langs, size = [], [], 0
    for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if texts and size + len(data) > PIECE_BYTES:
            yield texts, langs
            texts, langs, size = [], [], 0
        texts.append(data)
        langs.append(lang.as_py())
        size += len(data)
    if texts:
        yield texts, langs


def vocabulary(docs: DataFrame, salt: int = 0, tries: int = 8) -> tuple[DataFrame, int]:
    """(stored table (name, lang, word, f) of all words, salt under which all names differ)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(salt)
        for batch in batches:
            for texts, langs in _texts(batch):
                names, _, text, check, data, begin, end = words(texts, langs, second=True)
                order = np.argsort(names)
                names, check = names[order], check[order]
                fresh = np.ones(len(names), bool)
                # two words of one name are two rows here
                fresh[1:] = (names[1:] != names[:-1]) | (check[1:] != check[:-1])
                at = np.flatnonzero(fresh)
                whole, one = LOWER[data].tobytes(), order[at]
                told = [whole[b:e] for b, e in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(names[at].view(np.int64)), pa.array([langs[t] for t in text[one].tolist()], pa.string()),
                    pa.array(told, pa.binary()).cast(pa.string()), pa.array(np.diff(np.append(at, len(names)))),
                ], names=["name", "lang", "word", "f"])

    found = docs.mapInArrow(run, "name long, lang string, word string, f long").groupBy("name", "lang", "word").agg(F.sum("f").alias("f"))
    found = stored(found, "words")
    if found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return found, salt
    if tries == 1:
        raise RuntimeError("no salt gives all words different names")
    return vocabulary(docs, salt + 1, tries - 1)


def counted(docs: DataFrame, salt: int, width: int, least: int, pairs=None) -> DataFrame:
    """Stored (w1, .., f): runs of ``width`` words within pieces that occur ``least`` times or more.

    With ``pairs``, the broadcast filter of frequent pairs, a run is counted only where
    all its pairs may be frequent, as no run is more frequent than its parts. The filter
    may let others through, but never holds one back.
    """
    cols = [f"w{k + 1}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(salt)
        bits = None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        held, total = [], 0
        for batch in batches:
            for texts, langs in _texts(batch):
                names, pieces = words(texts, langs)[:2]
                held.append(_runs(names, pieces, width, bits))
                total += len(names)
                if total >= HELD_WORDS:
                    yield _grouped(held, cols)
                    held, total = [], 0
        if held:
            yield _grouped(held, cols)

    found = docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*cols, "f"]))
    return stored(found.groupBy(*cols).agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "counts")


def pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * PAIR + b)


def _runs(names: np.ndarray, pieces: np.ndarray, width: int, bits: np.ndarray | None) -> np.ndarray:
    """The names of the words of each run, one row per place in it."""
    n = len(names) - width + 1
    if n <= 0:
        return np.empty((width, 0), np.uint64)
    inside = pieces[:n] == pieces[width - 1 :]
    if bits is not None:
        frequent = in_filter(bits, pair_names(names[:-1], names[1:]))
        for k in range(width - 1):
            inside &= frequent[k : k + n]
    at = np.flatnonzero(inside)
    return np.stack([names[at + k] for k in range(width)])


def _grouped(held: list[np.ndarray], cols: list[str]) -> pa.RecordBatch:
    """Runs with their counts. Two runs of one hash may come out in several rows, which Spark adds up."""
    runs = np.concatenate(held, axis=1)
    key = np.zeros(runs.shape[1], np.uint64)
    for row in runs:
        key = pair_names(key, row)
    runs = runs[:, np.argsort(key)]
    fresh = np.ones(runs.shape[1], bool)
    fresh[1:] = (runs[:, 1:] != runs[:, :-1]).any(axis=0)
    at = np.flatnonzero(fresh)
    return pa.RecordBatch.from_arrays([*(pa.array(r[at].view(np.int64)) for r in runs), pa.array(np.diff(np.append(at, runs.shape[1])))], names=[*cols, "f"])


def pair_filter(pairs: DataFrame):
    """Broadcast filter of the pairs (w1, w2), of 32 bits a pair and ``FILTER_BYTES`` at most."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2"))
            yield pa.RecordBatch.from_arrays([pa.array(pair_names(a, b).view(np.int64))], names=["symbol"])

    size = min(FILTER_BYTES, max(1 << 16, 4 * pairs.count()))
    return _bit_filter(pairs.select("w1", "w2").mapInArrow(run, "symbol long"), size)


def lockstep(pairs: DataFrame, triples: DataFrame, outer: str) -> DataFrame:
    """Triples next to the pair they extend, read off one sorted stream.

    ``pairs`` (k1, k2, f, ``outer``) and ``triples`` (k1, k2, k3, f) are dealt out by ranges
    of (k1, k2) and sorted, a pair before its triples. One pass then gives each triple its
    pair's count and ``outer``, and each pair the count of its most frequent triple.
    Returns (k1, k2, k3, f, ``outer``, other): ``k3`` is null for a pair; ``other`` is a
    pair's most frequent extension (0 if none), or the count of a triple's pair.
    """
    spark = pairs.sparkSession
    both = pairs.select("k1", "k2", F.lit(None).cast("long").alias("k3"), "f", outer).unionByName(triples.select("k1", "k2", "k3", "f", F.lit(None).cast("long").alias(outer)))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartitionByRange(shards, "k1", "k2").sortWithinPartitions("k1", "k2", F.col("k3").isNotNull(), "k3")
    names = ["k1", "k2", "k3", "f", outer, "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the pair whose triples may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            k1, k2, f, out = (table.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "f", outer))
            triple = ~table.column("k3").is_null().to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(~triple)
            if heads[0]:
                raise ValueError("a triple without its pair")
            of = heads[np.cumsum(~triple) - 1]
            if (k1[of] != k1).any() or (k2[of] != k2).any():
                raise ValueError("a triple without its pair")
            most = np.maximum.reduceat(np.where(triple, f, 0), heads)
            # a pair that was carried over brings what its earlier triples had
            if last is not None:
                most[0] = max(most[0], carried)
            other = np.where(triple, f[of], 0)
            other[heads] = most
            filled = np.where(triple, out[of], out).astype(np.int64)
            keep = np.ones(len(f), bool)
            keep[heads[-1]] = False
            last, carried = table.slice(heads[-1], 1).to_batches()[0], int(most[-1])
            told = pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("k1", "k2", "k3", "f")), pa.array(filled), pa.array(other.astype(np.int64))], names=names)
            yield told.filter(pa.array(keep))
        if last is not None:
            yield pa.RecordBatch.from_arrays([*(last.column(c) for c in ("k1", "k2", "k3", "f", outer)), pa.array([carried])], names=names)

    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) for counts of up to 15 digits."""
    whole = lambda c: c.cast("decimal(16,0)")
    top = (F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)).cast("decimal(31,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (whole(left) * whole(right)).cast("decimal(32,0)")).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, cover: int = COVER, top: int = TOP) -> DataFrame:
    """The best phrases of two or three words of each language.

    1. One pass counts words and proves their 64-bit names unique; one counts pairs; one
       counts triples where both pairs are frequent.
    2. Pairs and triples are sorted in prefix order, where a triple follows the pair of its
       first two words, and in suffix order, where it follows that of its last two. One
       pass over each stream gives the counts of both parts of every cut and each pair's
       most frequent extension; the two streams are merge-joined.
    3. A candidate's score is that of its lowest cut, floor(1000000 a^2 / (l r)), of equal
       ones the first. A pair inside a triple of ``cover`` percent of its count or more is
       dropped. The ``top`` candidates of a language are ranked in groups first.

    Returns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the
    language), ``score``. Case is folded for A-Z only. Ties are broken by ``a`` and by the
    phrase's bytes.

    * A null text is empty, a null language ``und``. Repeated rows count as often as they
      stand there. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words, salt = vocabulary(docs)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = stored(words.filter(F.col("f") >= least), "frequent")
    pairs = counted(docs, salt, 2, least)
    triples = counted(docs, salt, 3, least, pair_filter(pairs))
    word = lambda k, f: frequent.select(F.col("name").alias(k), F.col("f").alias(f)).hint("merge")
    known = stored(pairs.join(word("w1", "f1"), "w1").join(word("w2", "f2"), "w2"), "pairs")
    c = F.col
    prefix = lockstep(known.select(c("w1").alias("k1"), c("w2").alias("k2"), "f", "f1"), triples.select(c("w1").alias("k1"), c("w2").alias("k2"), c("w3").alias("k3"), "f"), "f1")
    suffix = lockstep(known.select(c("w2").alias("k1"), c("w1").alias("k2"), "f", "f2"), triples.select(c("w3").alias("k1"), c("w2").alias("k2"), c("w1").alias("k3"), "f"), "f2")
    three = c("k3").isNotNull()
    # word names in order; the third is 0 in a pair, which is told by ``three``
    first = prefix.select(three.alias("three"), c("k1").alias("w1"), c("k2").alias("w2"), F.coalesce("k3", F.lit(0)).alias("w3"), "f", "f1", c("other").alias("right"))
    second = suffix.select(
        three.alias("three"), F.when(three, c("k3")).otherwise(c("k2")).alias("w1"), F.when(three, c("k2")).otherwise(c("k1")).alias("w2"),
        F.when(three, c("k1")).otherwise(0).alias("w3"), "f2", c("other").alias("left"),
    )
    met = first.join(second.hint("merge"), ["w1", "w2", "w3", "three"])
    met = met.filter(c("three") | (100 * F.greatest("left", "right") < cover * c("f")))
    # a triple is cut after its first word (f1 and the pair of the last two) or after its second
    cuts = F.when(c("three"), F.least(_cut(c("f1"), c("left"), 1), _cut(c("right"), c("f2"), 2))).otherwise(_cut(c("f1"), c("f2"), 1))
    scored = met.withColumn("cut", cuts).select("w1", "w2", "w3", "three", c("f").alias("a"), "cut.l", "cut.r", "cut.score")
    told = lambda k: frequent.select(c("name").alias(k), c("word").alias(f"t{k[1]}"), *([c("lang")] if k == "w1" else []))
    spelt = scored.join(told("w1"), "w1").join(told("w2"), "w2").join(told("w3"), "w3", "left")
    phrase = F.when(c("three"), F.concat_ws(" ", "t1", "t2", "t3")).otherwise(F.concat_ws(" ", "t1", "t2"))
    best = spelt.select("lang", phrase.alias("phrase"), "a", "l", "r", "score", F.xxhash64("w1", "w2", "w3").alias("_h"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in SALTS:
        group = Window.partitionBy("lang", F.pmod("_h", F.lit(salts))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(group).cast("long")).filter(c("rank") <= top)
    return best.join(small_side(stored(totals, "totals")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(left: Column, right: Column, k: int) -> Column:
    return F.struct(exact_score(F.col("f"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
