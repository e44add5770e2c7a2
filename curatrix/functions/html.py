"""HTML helpers: small Arrow UDFs over the standard parser, used where patterns are not enough."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_SKIP = {"script", "style", "noscript", "template", "svg"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_MAIN_CLASSES = {"event", "event-content"}
_CARD_WORDS = ("event", "card", "listing", "show", "calendar")  # fixed values: class names of listing items


class _Walk(HTMLParser):
    """Collects text chunks of the first main node and of the whole page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.everything, self.main = [], []
        self.skip = self.depth = 0
        self.main_depth = None
        self.main_done = False
        self.cards: dict[str, int] = {}
        self.counts = {"address": 0, "time": 0, "itemtype_event": 0, "ticket_links": 0}

    def handle_starttag(self, tag, attrs):
        attr = {k: (v or "") for k, v in attrs}
        if tag in _SKIP:
            self.skip += 1
            return
        classes = set(attr.get("class", "").split())
        if tag in ("address", "time"):
            self.counts[tag] += 1
        if "schema.org/event" in attr.get("itemtype", "").lower():
            self.counts["itemtype_event"] += 1
        if tag == "a" and "ticket" in attr.get("href", "").lower():
            self.counts["ticket_links"] += 1
        for c in classes:
            if any(word in c.lower() for word in _CARD_WORDS):
                self.cards[c.lower()] = self.cards.get(c.lower(), 0) + 1
        if tag in _VOID:
            return
        self.depth += 1
        is_main = tag in ("main", "article") or attr.get("role") == "main" or classes & _MAIN_CLASSES
        if is_main and self.main_depth is None and not self.main_done:
            self.main_depth = self.depth

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if tag in _VOID:
            return
        if self.main_depth is not None and self.depth <= self.main_depth:
            self.main_depth, self.main_done = None, True
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        chunk = data.strip()
        if chunk and not self.skip:
            self.everything.append(chunk)
            if self.main_depth is not None:
                self.main.append(chunk)


def _walk(page: str) -> _Walk:
    w = _Walk()
    w.feed(page or "")
    w.close()
    return w


def page_text(page: str | None) -> str:
    """Visible text of the whole page, main node first."""
    w = _walk(page)
    return " ".join(w.main + w.everything)


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    """``page_text`` as a column."""
    return pages.map(page_text)


#: Pages of a batch are read and returned together up to so many bytes.
TOGETHER = 1 << 20


def with_page_text(pages: DataFrame, html: str, out: str) -> DataFrame:
    """``pages`` with ``page_text`` in column ``out`` in place of ``html``.

    A task holds the Arrow batch it was given and the texts of a stretch of it, not those
    of the whole batch as ``html_to_text`` does.
    """
    keep = [c for c in pages.columns if c != html]
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField(out, T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(html)), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(sizes, dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                before = upto[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(upto, before + TOGETHER, side="right")))
                part = batch.slice(start, stop - start)
                texts = pa.array((page_text(p.as_py()) for p in part.column(html)), pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], texts], schema=arrow)
                start = stop

    return pages.mapInArrow(run, schema)


HTML_STATS = T.StructType([
    T.StructField(n, T.IntegerType()) for n in ("address", "time", "itemtype_event", "ticket_links", "cards")
])


@F.pandas_udf(HTML_STATS)
def html_stats(pages: pd.Series) -> pd.DataFrame:
    """Element counts that need a parser."""
    def one(page):
        w = _walk(page)
        return {**w.counts, "cards": max(w.cards.values(), default=0)}

    return pd.DataFrame([one(p) for p in pages], columns=[f.name for f in HTML_STATS.fields])
