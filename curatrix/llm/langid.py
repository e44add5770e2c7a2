"""Languages of words and texts: script ranges, word scores, Viterbi with a switching penalty."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_sample, held_out, id_and_text, map_texts, sampled
from .wordhash import FACTOR, mixed, slice_hashes

#: Bound on the labelled texts that the word model is fitted on.
FIT_ROWS = 16_000
BUCKETS = 1 << 17
#: Log-likelihood that a change of language costs, and the most that one word may count against one.
SWITCH, FLOOR = 15.0, 12.0
UNKNOWN = "und"
#: So many new words are scored at once.
TOGETHER = 1 << 14


def _other_numbers() -> str:
    """Ranges of signs that count as word characters and are neither letters nor decimal digits (fractions, circled or Roman numbers)."""
    found = [c for c in range(0x110000) if (t := chr(c)).isalnum() and not t.isalpha() and not t.isdecimal()]
    starts = [c for k, c in enumerate(found) if not k or found[k - 1] != c - 1]
    ends = [c for k, c in enumerate(found) if k + 1 == len(found) or found[k + 1] != c + 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True))


LETTERS = re.compile(rf"[^\W\d_{_other_numbers()}]+")

# Code point ranges of scripts (Unicode blocks).
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
)
OTHER = len(SCRIPTS)


@lru_cache(maxsize=1 << 16)
def script_of(char: str) -> int:
    code = ord(char)
    return next((k for k, (_, ranges) in enumerate(SCRIPTS) if any(a <= code <= b for a, b in ranges)), OTHER)


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-letter pieces of many words and of the words themselves.

    Words stand one after the other with their ends marked. Returns for each sign the
    buckets of the pieces that begin there (``BUCKETS``: none of that length), the place
    where each word begins, and the bucket of each word.
    """
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(sizes) - sizes
    left = np.repeat(begin + sizes, sizes) - np.arange(len(codes))
    own = mixed(codes + np.uint64(1))
    grams = np.full((len(codes), 3), BUCKETS, np.int64)
    hashes = own.copy()
    for n in range(3):
        at = np.flatnonzero(left > n)
        if n:
            hashes[at] = mixed(hashes[at] * np.uint64(FACTOR) + own[at + n])
        grams[at, n] = (hashes[at] % np.uint64(BUCKETS)).astype(np.int64)
    whole = (slice_hashes(own, begin + 1, begin + sizes - 1) % np.uint64(BUCKETS)).astype(np.int64)
    return grams, begin, whole


def counted_buckets(words: dict[str, int]) -> np.ndarray:
    """How often each bucket, and behind the buckets each script of a first letter, occurs in counted words."""
    total = np.zeros(BUCKETS + OTHER + 1)
    names = list(words)
    for start in range(0, len(names), TOGETHER):
        part = names[start : start + TOGETHER]
        times = np.array([words[w] for w in part], float)
        grams, begin, whole = word_buckets(part)
        sizes = np.diff(np.append(begin, len(grams)))
        pieces = np.bincount(grams.ravel(), weights=np.repeat(times, 3 * sizes), minlength=BUCKETS + 1)[:BUCKETS]
        total[:BUCKETS] += pieces + np.bincount(whole, weights=times, minlength=BUCKETS)
        total[BUCKETS:] += np.bincount([script_of(w[0]) for w in part], weights=times, minlength=OTHER + 1)
    return total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> dict:
    """Languages with their log-probabilities of buckets and the scripts they use.

    Learns from at most about ``rows`` texts with a language whose id is not held out.
    Counts are made in tasks and summed by Spark; what reaches the driver is bounded by
    languages x (buckets + scripts).
    """
    labelled = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = labelled.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    _, share = bounded_sample(labelled.select("doc_id"), rows)
    out = "lang string, bucket int, weight double"

    def count(batches):
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                seen.setdefault(lang.as_py(), Counter()).update(LETTERS.findall(text.as_py().lower()))
            for lang, words in seen.items():
                own = counted_buckets(words)
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "weight"])

    counted = sampled(labelled, share).select("text", "lang").mapInArrow(count, StructType.fromDDL(out))
    found = counted.groupBy("lang", "bucket").agg(F.sum("weight").alias("weight")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + OTHER + 1))
    table[[langs.index(x) for x in found["lang"]], found["bucket"].to_numpy(np.int64)] = found["weight"].to_numpy()
    seen = table[:, :BUCKETS] + 0.5
    scripts = table[:, BUCKETS:]
    used = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return {"langs": langs, "logs": np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32).T.copy(), "used": used}


class WordScores:
    """Rows of words in a growing matrix of scores by language; emptied when it has grown large."""

    def __init__(self, model: dict, limit: int = 300_000):
        self.model, self.limit = model, limit
        # a last row of zeros for pieces that are not there
        self.logs = np.concatenate([model["logs"], np.zeros((1, len(model["langs"])), np.float32)])
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model["langs"])), np.float32)

    def learn(self, words: list[list[str]]) -> None:
        """Makes room for all words of a slice of texts; rows stay valid until the next call."""
        if len(self.at) > self.limit:
            self.clear()
        # in a stated order, so that sums do not hang on the order of a set
        new = sorted(set().union(*words).difference(self.at))
        for start in range(0, len(new), TOGETHER):
            part = new[start : start + TOGETHER]
            have = len(self.at)
            if have + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(part), len(self.rows)), self.rows.shape[1]), np.float32)])
            grams, begin, whole = word_buckets(part)
            scores = np.add.reduceat(self.logs[grams].sum(axis=1), begin, axis=0) + self.logs[whole]
            fits = self.model["used"][:, [script_of(w[0]) for w in part]].T
            scores = np.where(fits | ~fits.any(axis=1, keepdims=True), scores, -np.inf)
            self.rows[have : have + len(part)] = np.maximum(scores - scores.max(axis=1, keepdims=True), -FLOOR)
            self.at.update(zip(part, range(have, have + len(part)), strict=True))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word of several texts, stepped through side by side.

    ``scores`` holds the texts' words one text after the other; the longest text must
    come first. Staying is free and any change costs ``switch``.
    """
    starts = np.cumsum(lengths) - lengths
    stay = np.zeros(scores.shape, bool)
    best_before = np.zeros(len(scores), np.int32)
    if not len(scores):
        return best_before
    best = scores[starts[lengths > 0]].copy()
    ends = np.zeros((len(lengths), scores.shape[1]), scores.dtype)
    active = int((lengths > 0).sum())
    for t in range(1, int(lengths[0])):
        now = int(np.searchsorted(-lengths, -t, side="left"))
        if now < active:
            ends[now:active] = best[now:active]
            best, active = best[:now], now
        at = starts[:active] + t
        top = best.argmax(axis=1)
        changed = best[np.arange(active), top] - switch
        keep = best >= changed[:, None]
        stay[at] = keep
        best_before[at] = top
        best = np.where(keep, best, changed[:, None]) + scores[at]
    ends[:active] = best
    labels = np.zeros(len(scores), np.int32)
    state = np.zeros(len(lengths), np.int32)
    active = 0
    for t in range(int(lengths[0]) - 1, -1, -1):
        now = int(np.searchsorted(-lengths, -t, side="left"))
        if now > active:
            state[active:now] = ends[active:now].argmax(axis=1)
            active = now
        at = starts[:active] + t
        labels[at] = state[:active]
        if t:
            state[:active] = np.where(stay[at, state[:active]], state[:active], best_before[at])
    return labels


def best_labels(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """As ``viterbi``; where all words of a text have the same best language, that is the path and no search is made.

    The best language of a word has score 0 and no path is above 0. Of languages with score
    0 in all words the first is taken, as in ``viterbi``.
    """
    if not len(scores):
        return np.zeros(0, np.int32)
    labels = scores.argmax(axis=1).astype(np.int32)
    some = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    mixed_texts = np.zeros(len(lengths), bool)
    mixed_texts[some] = np.minimum.reduceat(labels, starts) != np.maximum.reduceat(labels, starts)
    at = np.repeat(mixed_texts, lengths)
    if at.any():
        labels[at] = viterbi(scores[at], lengths[mixed_texts], switch)
    return labels


def label_texts(texts: list, scores: WordScores, switch: float) -> list[tuple[str, float, list]]:
    """(language, share of letters, spans) of each text."""
    langs = scores.model["langs"]
    if not langs:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    lows = [(t or "").lower() for t in texts]
    words = [LETTERS.findall(t) for t in lows]
    scores.learn(words)
    order = sorted(range(len(texts)), key=lambda k: -len(words[k]))
    lengths = np.array([len(words[k]) for k in order], np.int64)
    flat = list(chain.from_iterable(words[k] for k in order))
    found = scores.rows[np.fromiter(map(scores.at.__getitem__, flat), np.int64, len(flat))]
    labels = best_labels(found, lengths, switch)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    at = 0
    for k, n in zip(order, lengths, strict=True):
        if n:
            own, weight = labels[at : at + n], sizes[at : at + n]
            totals = np.bincount(own, weights=weight, minlength=len(langs))
            top = int(totals.argmax())
            cuts = np.flatnonzero(np.diff(own)) + 1
            firsts = [0, *cuts.tolist()]
            lasts = [*(cuts - 1).tolist(), n - 1]
            if len(cuts):
                places = [m.span() for m in LETTERS.finditer(lows[k])]
            else:
                first, last = words[k][0], words[k][-1]
                places = {n - 1: (0, lows[k].rfind(last) + len(last))}
                places[0] = (lows[k].find(first), places[n - 1][1])
            spans = [{"lang": langs[own[a]], "start": places[a][0], "end": places[b][1]} for a, b in zip(firsts, lasts, strict=True)]
            out[k] = (langs[top], float(totals[top] / totals.sum()), spans)
        at += n
    return out


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``spans`` of each whole text.

    Words keep the languages that use their script; Viterbi then finds the labels of all
    words at the least cost. ``lang_pred`` has most letters, ``score`` is its share of
    them, ``spans`` are the runs of one language in characters of the lower-cased text.

    * A null text, or one without letters, is ``und`` with score 0 and no spans; so is
      every text when nothing was learnt.
    * Ties take the language that sorts first. Repeated rows and null ids pass through.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        scores = WordScores(held.value)

        def work(texts: list) -> dict:
            rows = label_texts(texts, scores, switch)
            return {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": [r[2] for r in rows]}

        return work

    marked = id_and_text(docs, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return map_texts(marked, prepare, "lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>", slice_rows=1024)
