"""Words and rolling hashes of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(0xC0FFEE)
#: A random odd number for each byte value.
BYTE_CODES = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Powers of a number that a worker keeps; longer tables, for longer texts, live as long as their user.
KEEP_POWERS = 1 << 19


def powers(base: np.uint64, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """The first n powers of base, modulo 2^64."""
    have = _kept.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, KEEP_POWERS), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) == KEEP_POWERS:
            _kept[int(base)] = have
    return have[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column's texts, one after the other, and their n + 1 offsets; null texts are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    return raw, ends - ends[0]


class Words:
    """start, end (bytes), doc (row) and hash of every word of the texts; words are runs of bytes that are no blanks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        n = len(data)
        self.docs = len(offsets) - 1
        if lower:
            data = _LOWER[data]
        ink = ~BLANK[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[1:], before[0] = ink[:-1], False
            after[:-1], after[-1] = ink[1:], False
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < n)]
            before[edges] = False
            after[edges - 1] = False
        self.start = np.flatnonzero(ink & ~before)
        self.end = np.flatnonzero(ink & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * powers(STEP, n), out=sums[1:])
        self.hash = scramble((sums[self.end] - sums[self.start]) * powers(STEP_BACK, n + 1)[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.doc, np.arange(self.docs + 1))  # of each doc's words

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether all k are of one text; len(words) - k + 1 entries."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        g = np.zeros(m, np.uint64)
        for j in range(k):
            g = g * STEP + self.hash[j : j + m]
        return scramble(g), self.doc[:m] == self.doc[k - 1 :]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w entries in a row; len(x) - w + 1 entries."""
    out, done = x, 1
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out
