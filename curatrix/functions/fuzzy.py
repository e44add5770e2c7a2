"""String similarity on a 0-100 scale: Arrow UDFs for indel scores, a native Levenshtein form for JVM-only plans."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lcs import lcs_lengths


def _masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(a):
        out[ch] = out.get(ch, 0) | (1 << i)
    return out


def _lcs(masks: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step per character of ``b``."""
    full = (1 << n) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * _lcs(_masks(a), len(a), b) / (len(a) + len(b))


def partial(a: str, b: str, cutoff: float = 0.0) -> float:
    """Best ratio of the shorter text against windows of the longer one; 0 when below ``cutoff``."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    masks = _masks(a)
    whole = _lcs(masks, len(a), b)
    # a window of w characters scores 200*lcs/(m+w) with lcs <= whole and w >= lcs
    if whole == 0 or 200.0 * whole / (len(a) + whole) < cutoff:
        return 0.0
    best = _partial_into(a, b, masks, whole)
    if len(a) == len(b) and best < 100:
        best = max(best, _partial_into(b, a, _masks(b), whole))
    return best if best >= cutoff else 0.0


def _partial_into(short: str, long: str, masks: dict[str, int], whole: int) -> float:
    m, n = len(short), len(long)
    best = 0.0
    for end in range(1, n + m):
        lo, hi = max(0, end - m), min(end, n)
        width = hi - lo
        if long[hi - 1 if end <= n else lo] not in masks or 200.0 * min(whole, width) / (m + width) <= best:
            continue
        best = max(best, 200.0 * _lcs(masks, m, long[lo:hi]) / (m + width))
        if best == 100.0:
            break
    return best


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both, left, right = sorted(ta & tb), " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
    if both and (not left or not right):
        return 100.0
    base = len(" ".join(both))
    la, lb = base + bool(base) + len(left), base + bool(base) + len(right)
    edits = len(left) + len(right) - 2 * _lcs(_masks(left), len(left), right)
    best = 100.0 - 100.0 * edits / (la + lb)
    if base:
        best = max(best, *(100.0 - 100.0 * (1 + len(x)) / (base + n) for x, n in ((left, la), (right, lb))))
    return best


def ratios(a: Sequence[str], b: Sequence[str], common: np.ndarray | None = None) -> np.ndarray:
    """``ratio`` of many pairs; ``common`` are their longest common subsequences, if known."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    common = lcs_lengths(a, b) if common is None else common
    return np.where(total == 0, 100.0, 200.0 * common / np.where(total == 0, 1, total))


def partials(a: Sequence[str], b: Sequence[str], cutoff: float = 0.0, common: np.ndarray | None = None) -> np.ndarray:
    """``partial`` of many pairs; only those that the whole texts leave above ``cutoff`` are looked at window by window."""
    common = lcs_lengths(a, b) if common is None else common
    short = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.float64)
    bound = 200.0 * common / np.maximum(short + common, 1)
    out = np.zeros(len(a))
    for k in np.flatnonzero((short == 0) | ((common > 0) & (bound >= cutoff))).tolist():
        out[k] = partial(a[k], b[k], cutoff)
    return out


def token_sorts(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return ratios(*([" ".join(sorted(x.split())) for x in side] for side in (a, b)))


def token_sets(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``token_set`` of many pairs: words first, then one comparison of what is left of both sides."""
    rows, out = [], np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        ta, tb = set(x.split()), set(y.split())
        if ta and tb:
            left, right = " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
            base = len(" ".join(ta & tb))
            if base and (not left or not right):
                out[k] = 100.0
            else:
                rows.append((k, base, left, right))
    if rows:
        at, base = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:2])
        left, right = [r[2] for r in rows], [r[3] for r in rows]
        n, m = (np.array([len(t) for t in side], np.float64) for side in (left, right))
        gap = (base > 0).astype(np.float64)
        la, lb = base + gap + n, base + gap + m
        best = 100.0 - 100.0 * (n + m - 2 * lcs_lengths(left, right)) / (la + lb)
        with_base = np.maximum(100.0 - 100.0 * (1 + n) / (base + la), 100.0 - 100.0 * (1 + m) / (base + lb))
        out[at] = np.where(base > 0, np.maximum(best, with_base), best)
    return out


def _score(scores):
    """Pair scores as an Arrow UDF, NULL where a side is.

    Marked nondeterministic so that the optimizer neither evaluates it twice nor moves a
    filter on it below the shuffle that spreads the pairs.
    """
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[known] = scores(a[known].tolist(), b[known].tolist())
        return pd.Series(out, dtype="float64").where(known, None)

    return F.pandas_udf(run, T.DoubleType()).asNondeterministic()


indel_ratio = _score(ratios)
partial_ratio = _score(partials)
token_sort_ratio = _score(token_sorts)
token_set_ratio = _score(token_sets)
sequence_ratio = _score(lambda a, b: [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("ratio", "partial", "token_set")])


@F.pandas_udf(SCORES)
def name_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The three scores the address tiers use, in one pass; partial scores below every tier's limit come back as 0."""
    a, b = a.tolist(), b.tolist()
    common = lcs_lengths(a, b)
    return pd.DataFrame({"ratio": ratios(a, b, common), "partial": partials(a, b, 80.0, common), "token_set": token_sets(a, b)}, dtype="float64")


name_scores = name_scores.asNondeterministic()


def lev_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - edit distance / longer length), all in the JVM."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 100.0).otherwise((1 - F.levenshtein(a, b) / longer) * 100)


def lev_scores(a: Column, b: Column) -> Column:
    r = lev_ratio(a, b)
    return F.struct(r.alias("ratio"), r.alias("partial"), r.alias("token_set"))
