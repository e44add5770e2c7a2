"""Long passages that repeat across documents, found by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts, small_side, stored
from .wordhash import WHITE, WordHasher, byte_table, mixed, slice_hashes

WINDOW = 13
ROUNDS = 2
#: Bytes of the filter of repeated names that each task holds.
FILTER_BYTES = 16 << 20
PAGE_BITS = 15
SLICE_BYTES = 1 << 19


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_keys(h: np.ndarray, first: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """A symbol inside each window of ``width`` words, the same for equal windows wherever they stand.

    ``h`` holds the word names of several texts, ``first`` marks the words that begin a
    text. Runs of one word get one name; then, round by round, names are dealt into left
    and right ones by a hash, and each left name that stands before a right one is joined
    with it. Names are hashes of what they stand for, so all tasks agree on them.

    A border between two names inside a window is cut or kept alike in all equal windows,
    except next to the window's ends, where names outside may take part: a right name at
    the left end may be joined with its left neighbour, a left name at the right end with
    its right one. ``left`` and ``right`` hold, for each window, the part that no name
    outside can change. The key is the longest pair of neighbours in that part, or its one
    name, at the highest level at which there is one; without any (long runs), it is the
    name of the whole window.

    Returns one key per word position; those of windows that leave their text are not valid.
    """
    n = len(h)
    keys = window_names(h, width)
    new_run = np.ones(n, bool)
    new_run[1:] = (h[1:] != h[:-1]) | first[1:]
    starts = np.flatnonzero(new_run)
    sizes = np.diff(np.append(starts, n))
    names = mixed(h[starts] + np.uint64(0x9E3779B97F4A7C15) * sizes.astype(np.uint64))
    hard = first[starts]
    of_word = np.cumsum(new_run) - 1
    last = np.minimum(np.arange(n) + width, n) - 1
    left, right = (starts + sizes)[of_word], starts[of_word[last]]
    # block that starts, and that ends, at a word position
    begins, stops = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for level in range(rounds + 1):
        inside = np.flatnonzero(left < right)
        if not len(inside):
            break
        begins[starts] = np.arange(len(starts))
        stops[starts + sizes] = np.arange(len(starts))
        at = begins[left[inside]]
        keys[inside] = mixed(best_names(at, right[inside], starts, sizes, names) + np.uint64(level + 1))
        if level == rounds:
            break
        to_right = (mixed(names + np.uint64(0xD1B54A32D192ED03 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        left[inside] += np.where(to_right[at], sizes[at], 0)
        end = stops[right[inside]]
        right[inside] -= np.where(to_right[end], 0, sizes[end])
        joins = np.flatnonzero(~to_right[:-1] & to_right[1:] & ~hard[1:])
        names[joins] = mixed(names[joins] * np.uint64(0x9E3779B97F4A7C15) + mixed(names[joins + 1] + np.uint64(level + 1)))
        sizes[joins] += sizes[joins + 1]
        keep = np.ones(len(starts), bool)
        keep[joins + 1] = False
        starts, sizes, names, hard = starts[keep], sizes[keep], names[keep], hard[keep]
    return keys


def best_names(at: np.ndarray, right: np.ndarray, starts: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Of the names and pairs of neighbours from ``at`` on that end by ``right``, one name of the longest; the first of equals."""
    ends, n = starts + sizes, len(starts)
    best, length, pair = at.copy(), sizes[at].copy(), np.zeros(len(at), bool)
    step, open_ = at, np.arange(len(at))
    while len(open_):
        s = step[open_]
        size = sizes[s]
        after = np.minimum(s + 1, n - 1)
        both = (after > s) & (ends[after] <= right[open_])
        size = np.where(both, ends[after] - starts[s], size)
        better = size > length[open_]
        w = open_[better]
        best[w], length[w], pair[w] = s[better], size[better], both[better]
        open_ = open_[both]
        step = step.copy()
        step[open_] += 1
    found = names[best]
    return np.where(pair, mixed(found * np.uint64(0x9E3779B97F4A7C15) + names[np.minimum(best + 1, n - 1)]), found)


def window_names(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit names of the ``width`` words from each position on; less wide where the words end."""
    begin = np.arange(len(h))
    return slice_hashes(mixed(h), begin, np.minimum(begin + width, len(h)))


def windows(batch: pa.RecordBatch, hasher: WordHasher, width: int) -> Iterator[tuple]:
    """(row numbers, word hashes, positions in their texts, valid windows, beginnings) of slices of a batch.

    A slice has ``SLICE_BYTES`` of text or is a single text, which bounds the memory of the arrays made of it.
    """
    start, texts, size = 0, [], 0
    for number, text in enumerate(batch.column("text")):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if texts and size + len(data) > SLICE_BYTES:
            yield _positions(start, texts, hasher, width)
            start, texts, size = number, [], 0
        texts.append(data)
        size += len(data)
    if texts:
        yield _positions(start, texts, hasher, width)


def _positions(start: int, texts: list[bytes], hasher: WordHasher, width: int) -> tuple:
    h, counts = hasher(texts)
    begins = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(texts)), counts)
    position = np.arange(len(h)) - begins[row]
    return start + row, h, position, np.flatnonzero(position + width <= counts[row]), position == 0


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, rounds: int = ROUNDS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Removes each word covered by a window of ``width`` words that also starts in a document with a smaller id.

    1. Of equal texts only the first is worked on; the others lose all words, if they have
       a window. The texts that may be copies are told by a filter of fixed size.
    2. Recompression gives each window a symbol inside it that equal windows share (see
       ``window_keys``). A text has about one distinct symbol per four words.
    3. Spark counts the symbols by document; those of two documents or more are set in a
       filter of fixed size, which all tasks hold. A filter that is too small for its
       table lets more windows through, but never loses one.
    4. Windows whose symbol is in the filter are compared by their own 80-bit names: the
       smallest id is aggregated map-side and joined back, so that a window of very many
       documents can be split.
    5. The positions found return to their texts.

    Returns per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``,
    ``kept_text`` (kept words joined by one space), ``removed`` (runs of removed words,
    first and last position).

    * A null or empty text has no words. Texts shorter than a window keep all words.
    * Rows with a null id are returned whole and count for no other row.
    * Rows repeated under one id are one document: they do not repeat each other, and a
      position found in one of them is removed from all.
    """
    texts = id_and_text(docs, id_col, text_col).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    known = texts.filter("doc_id is not null and text is not null")
    groups = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    groups = stored(groups.select("h1", "h2", "low"), "copies")
    copied = _bit_filter(groups.select(F.col("h1").alias("symbol")), filter_bytes)
    firsts = known.mapInArrow(_split(copied, True), known.schema).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text")).alias("m"))
    firsts = stored(firsts.select("m.doc_id", "m.text"), "firsts")
    single = _split(copied, False)
    table = byte_table(WHITE, lower=False)

    def symbols(batches):
        hasher = WordHasher(table)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for row, h, _, at, first in windows(batch, hasher, width):
                if len(at):
                    pairs = np.stack([ids[row[at]].view(np.uint64), window_keys(h, first, width, rounds)[at]])
                    pairs = pairs[:, np.lexsort(pairs[::-1])]
                    fresh = np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0))
                    out = pairs[:, fresh].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(out[1]), pa.array(out[0])], names=["symbol", "doc_id"])

    # one after the other in the same Python worker: a step of its own would hold a second worker and its batches
    both = lambda run, schema: known.mapInArrow(lambda batches: run(single(batches)), schema).unionByName(firsts.mapInArrow(run, schema))
    counted = both(symbols, "symbol long, doc_id long").groupBy("symbol").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = _bit_filter(counted.filter("low < high").select("symbol"), filter_bytes)

    def candidates(batches):
        hasher, bits = WordHasher(table), np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for row, h, position, at, first in windows(batch, hasher, width):
                if len(at):
                    at = at[in_filter(bits, window_keys(h, first, width, rounds)[at])]
                if len(at):
                    check = (window_names(~h, width)[at] >> np.uint64(48)).astype(np.uint16).view(np.int16)
                    arrays = [pa.array(window_names(h, width)[at].view(np.int64)), pa.array(check), pa.array(ids[row[at]]), pa.array(position[at].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["name", "check", "doc_id", "position"])

    named = stored(both(candidates, "name long, check short, doc_id long, position int"), "windows")
    lowest = named.groupBy("name", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    lowest = stored(lowest.filter("low < high").select("name", "check", "low"), "repeated")
    found = named.join(lowest, ["name", "check"]).filter("low < doc_id").groupBy("doc_id").agg(F.collect_list("position").alias("positions"))
    later = known.select("doc_id", "h1", "h2").join(groups, ["h1", "h2"]).filter("low < doc_id").select("doc_id").distinct()
    runs = "array<struct<first:int,last:int>>"
    gone = found.mapInArrow(_runs(width), f"doc_id long, runs {runs}").withColumn("copy", F.lit(False))
    gone = gone.unionByName(later.select("doc_id", F.lit(None).cast(runs).alias("runs"), F.lit(True).alias("copy")))
    gone = small_side(stored(gone.withColumnRenamed("doc_id", "_id"), "removed"))
    marked = texts.join(gone, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.struct("text", "runs", "copy").alias("text"))

    def prepare():
        def work(rows: list) -> dict:
            done = [cut_words(words_of(r["text"]), r["runs"] or [], width if r["copy"] else 0) for r in rows]
            return {
                "n_words": [d[0] for d in done],
                "n_removed": [d[1] for d in done],
                "kept_sha256": [hashlib.sha256(d[2]).hexdigest() for d in done],
                "kept_text": [d[2].decode("utf-8", "surrogatepass") for d in done],
                "removed": [d[3] for d in done],
            }

        return work

    return map_texts(marked, prepare, "n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<first:int,last:int>>")


def _runs(width: int) -> Callable:
    """Runs of words that the windows at ``positions`` cover."""

    def run(batches):
        for batch in batches:
            out = []
            for got in batch.column("positions"):
                at = np.unique(got.values.to_numpy())
                cut = np.flatnonzero(np.diff(at) > width) + 1
                out.append([{"first": int(p[0]), "last": int(p[-1]) + width - 1} for p in np.split(at, cut)])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "runs"])

    return run


def cut_words(words: list[bytes], runs: list[dict], copy_width: int) -> tuple[int, int, bytes, list]:
    """(words, removed words, kept text, removed runs) of one text; a copy loses all words if it has a window."""
    if copy_width:
        runs = [{"first": 0, "last": len(words) - 1}] if len(words) >= copy_width else []
    runs = [{"first": r["first"], "last": min(r["last"], len(words) - 1)} for r in runs if r["first"] < len(words)]
    kept, at = [], 0
    for r in runs:
        kept += words[at : r["first"]]
        at = r["last"] + 1
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept), runs


def _split(held, inside: bool) -> Callable:
    """Rows whose text hash is in the filter, or those whose is not."""

    def run(batches):
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            found = in_filter(bits, batch.column("h1").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(found if inside else ~found))

    return run


def _bit_filter(symbols: DataFrame, filter_bytes: int):
    """Broadcast bit array with a bit for each symbol; pages of it are built by Spark.

    A page never has more than ``2 ** PAGE_BITS`` positions, and all pages together are
    ``filter_bytes``, whatever the number of symbols.
    """
    spark = symbols.sparkSession
    bits = 1 << (8 * filter_bytes - 1).bit_length()
    bit = F.col("symbol").bitwiseAND(F.lit(bits - 1))
    places = symbols.select(F.shiftright(bit, PAGE_BITS).cast("int").alias("page"), bit.bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).cast("int").alias("bit"))
    pages = stored(places.groupBy("page").agg(F.collect_set("bit").alias("bits")), "filter")
    whole = np.zeros(bits // 8, np.uint8)
    size = 1 << (PAGE_BITS - 3)

    def packed(batches):
        for batch in batches:
            out = []
            for got in batch.column("bits"):
                page = np.zeros(1 << PAGE_BITS, np.uint8)
                page[got.values.to_numpy()] = 1
                out.append(np.packbits(page, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(out, pa.binary())], names=["page", "data"])

    for row in pages.mapInArrow(packed, "page int, data binary").toLocalIterator():
        whole[row.page * size : (row.page + 1) * size] = np.frombuffer(row.data, np.uint8)
    return spark.sparkContext.broadcast(whole.tobytes())


def in_filter(data: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    bit = symbols & np.uint64(8 * len(data) - 1)
    return (data[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
