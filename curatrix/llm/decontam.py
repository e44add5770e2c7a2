"""Benchmark passages in documents, found with one Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts

WINDOW = 10
AUTOMATON_BYTES = 32 << 20
#: Lower-cases A-Z and turns every ASCII byte that is not a letter or digit into a space.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<item_id:string,start:long,end:long>>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def item_windows(words: list[bytes], width: int) -> set[bytes]:
    """All runs of ``width`` words; a shorter item is one window."""
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def build_automaton(items: list[tuple[str, str]], width: int) -> ahocorasick.Automaton | None:
    """Automaton over the windows, each between spaces, with the items that hold it."""
    owners: dict[bytes, list[str]] = {}
    for item_id, text in items:
        for w in item_windows(normal_words(text), width):
            owners.setdefault(w, []).append(item_id)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for w, ids in owners.items():
        automaton.add_word(f" {w.decode('latin-1')} ", (len(w) + 2, w.count(b" ") + 1, tuple(ids)))
    automaton.make_automaton()
    return automaton


def scan_text(text: str | None, automata: list) -> tuple:
    """(words, hit words, item ids, spans) of one whole text; spans are offsets in the text as given."""
    words = normal_words(text)
    found: dict[tuple[int, int], set[str]] = {}
    if words:
        line = f" {b' '.join(words).decode('latin-1')} "
        begins = None
        for automaton in automata:
            for end, (size, count, ids) in automaton.iter(line):
                if begins is None:
                    sizes = np.fromiter(map(len, words), np.int64, len(words))
                    begins = np.cumsum(sizes + 1) - sizes
                first = int(np.searchsorted(begins, end - size + 2))
                found.setdefault((first, first + count), set()).update(ids)
    if not found:
        return len(words), 0, [], []
    edge = np.zeros(len(words) + 1, np.int64)
    for first, last in found:
        edge[first] += 1
        edge[last] -= 1
    places = [m.span() for m in WORD.finditer(text)]
    spans = sorted((item, places[a][0], places[b - 1][1]) for (a, b), ids in found.items() for item in ids)
    return len(words), int((np.cumsum(edge)[:-1] > 0).sum()), sorted({i for ids in found.values() for i in ids}), spans


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES, carry: bool = False) -> DataFrame:
    """Marks document words inside any occurrence of a window of ``window`` benchmark words.

    The benchmark is the small side. It is cut into parts of at most ``automaton_bytes``
    of text; each part is broadcast and becomes one automaton (usually there is one), and
    each document is scanned once per part. Parts are held in memory one after the other
    when there are several. Documents are never shuffled.

    Returns per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256``, ``contaminated``, ``item_ids``, ``spans`` (character offsets in the
    text as given).

    * A null or empty text has no words and is clean; so is everything against an empty
      benchmark. Items without words or with null text match nothing.
    * Overlapping windows and items with equal windows all count; a word is hit once.
    * Repeated rows and null ids are returned as they are, one row per input row.
    * With ``carry`` the input row comes along as the struct ``row``.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    parts, size = [[]], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if size and size + len(row.text) > automaton_bytes:
            parts.append([])
            size = 0
        parts[-1].append((row.item_id, row.text))
        size += len(row.text)
    held = [spark.sparkContext.broadcast(p) for p in parts]

    def prepare():
        single = [a for a in [build_automaton(held[0].value, window)] if a] if len(held) == 1 else None

        def scan(texts: list) -> dict:
            if single is not None:
                rows = [scan_text(t, single) for t in texts]
            else:
                rows = _scan_parts(texts, held, window)
            return {
                "n_words": [r[0] for r in rows],
                "n_hit": [r[1] for r in rows],
                "n_items": [len(r[2]) for r in rows],
                "items_sha256": [hashlib.sha256(",".join(r[2]).encode()).hexdigest() for r in rows],
                "contaminated": [r[1] > 0 for r in rows],
                "item_ids": [r[2] for r in rows],
                "spans": [[{"item_id": i, "start": a, "end": b} for i, a, b in r[3]] for r in rows],
            }

        return scan

    return map_texts(id_and_text(docs, id_col, text_col, carry), prepare, SCHEMA)


def _scan_parts(texts: list, held: list, window: int) -> list[tuple]:
    """As ``scan_text`` over several automata, of which one is in memory at a time."""
    ids: list[set] = [set() for _ in texts]
    spans: list[set] = [set() for _ in texts]
    for part in held:
        automaton = build_automaton(part.value, window)
        for k, t in enumerate(texts):
            _, _, i, s = scan_text(t, [automaton] if automaton else [])
            ids[k].update(i)
            spans[k].update(s)
    return [(len(normal_words(t)), _covered(t, s), sorted(i), sorted(s)) for t, i, s in zip(texts, ids, spans, strict=True)]


def _covered(text: str | None, spans: set[tuple[str, int, int]]) -> int:
    """Words inside any span."""
    if not spans:
        return 0
    begins = [m.start() for m in WORD.finditer(text)]
    hit: set[int] = set()
    for a, b in {(a, b) for _, a, b in spans}:
        hit.update(range(np.searchsorted(begins, a), np.searchsorted(begins, b)))
    return len(hit)
