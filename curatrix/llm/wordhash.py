"""64-bit hashes of all words of many texts at once."""

from __future__ import annotations

import numpy as np

#: An odd factor and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
PIECE = 1 << 20
GAP = 256


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the factor and of its inverse, kept as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> "Powers":
        if n > len(self.up):
            grow = lambda f: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, f, np.uint64))])
            self.up, self.down = grow(FACTOR), grow(INVERSE)
        return self


POWERS = Powers()


def slice_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[b:e]`` for each pair, the same wherever the slice stands."""
    p = POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p.up[: len(values)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * p.down[begin] + (end - begin).astype(np.uint64))


class WordHasher:
    """Hashes of words: the runs of bytes that are no separators (see ``byte_table``)."""

    def __init__(self, normal: np.ndarray):
        self.separator = normal == GAP
        self.values = mixed(normal.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words one text after the other, number of words of each text)."""
        hashes, counts, waiting, size = [], [], [], 0
        for t in texts:
            if size and size + len(t) > PIECE:
                self._piece(waiting, hashes, counts)
                waiting, size = [], 0
            waiting.append(t)
            size += len(t) + 1
        self._piece(waiting, hashes, counts)
        return np.concatenate(hashes), np.concatenate(counts)

    def _piece(self, texts: list[bytes], hashes: list, counts: list) -> None:
        data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        gap = self.separator[data]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        begin, end = edges[0::2], edges[1::2]
        hashes.append(slice_hashes(self.values[data], begin, end))
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(begin, ends, side="right")
        counts.append(np.diff(np.concatenate([[0], upto])))


def byte_table(separators, lower: bool) -> np.ndarray:
    """What each byte counts for: separators as ``GAP``, A-Z as a-z if ``lower``, the rest as itself."""
    table = np.arange(256, dtype=np.uint16)
    if lower:
        table[65:91] += 32
    table[list(separators)] = GAP
    return table


WHITE = (0x20, *range(0x09, 0x0E))
