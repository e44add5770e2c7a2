"""Longest common subsequences of many pairs of texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Pairs that are worked on together, and the sign that fills up short texts (no code point).
BATCH, NONE = 1 << 14, np.uint32(0xFFFFFFFF)
WORD = 64


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of code points, one row per text, filled up with ``NONE``; lengths)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(lengths.max(initial=0))), NONE, np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out, lengths


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair.

    Pairs stand side by side: bit ``i`` of a pair's row of 64-bit words says whether its
    state grows at place ``i`` of the shorter text, and all pairs take one step per sign of
    the longer text (Hyyrö's form of the bit-parallel method). Pairs are taken in the order
    of their lengths, so that a batch has about one width.
    """
    out = np.zeros(len(a), np.int64)
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    order = np.lexsort((np.array([len(y) for y in long], np.int64), np.array([len(x) for x in short], np.int64) // WORD))
    for start in range(0, len(order), BATCH):
        at = order[start : start + BATCH]
        out[at] = _batch([short[k] for k in at], [long[k] for k in at])
    return out


def _batch(short: list[str], long: list[str]) -> np.ndarray:
    x, m = code_points(short)
    y, n = code_points(long)
    words, octets = max(1, -(-x.shape[1] // WORD)), -(-x.shape[1] // 8)
    # signs as narrow as they can be; a cast leaves the filling sign at the type's largest value
    top = max((int(t[t != NONE].max(initial=0)) for t in (x, y)), default=0)
    x, y = (t.astype(np.uint8 if top < 0xFF else np.uint16 if top < 0xFFFF else np.uint32) for t in (x, y))
    same_octets = np.zeros((len(short), words * 8), np.uint8)
    state = np.full((len(short), words), ~np.uint64(0), np.uint64)
    # longest first, so that the pairs that still have signs are always the first rows
    order = np.argsort(-n, kind="stable")
    x, y, left = x[order], y[order], n[order]
    for j in range(y.shape[1]):
        rows = int(np.searchsorted(-left, -j, side="left"))
        same_octets[:rows, :octets] = np.packbits(x[:rows] == y[:rows, j][:, None], axis=1, bitorder="little")
        same = same_octets[:rows].view("<u8")
        s = state[:rows]
        u = s & same
        total = s + u
        carry = total < s
        # the sum of several words is carried on from the lowest one
        for k in range(words - 1):
            more = total[:, k + 1] + carry[:, k].astype(np.uint64)
            carry[:, k + 1] |= more < total[:, k + 1]
            total[:, k + 1] = more
        state[:rows] = total | (s - u)
    inside = np.arange(words * WORD)[None, :] < m[order][:, None]
    mask = np.packbits(inside, axis=1, bitorder="little").view("<u8")
    found = np.empty(len(short), np.int64)
    found[order] = np.bitwise_count(~state & mask).sum(axis=1)
    return found
