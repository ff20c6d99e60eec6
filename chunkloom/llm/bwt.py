"""Suffix order, Burrows-Wheeler transform and wavelet matrices of many short segments, on numpy arrays."""

from __future__ import annotations

import heapq

import numpy as np


class Bits:
    """A bit vector with rank queries: counts up to each 256 bits, and within these up to each 64."""

    def __init__(self, bit: np.ndarray) -> None:
        packed = np.packbits(bit, bitorder="little")
        blocks = (len(bit) >> 8) + 1
        self.word = np.zeros(4 * blocks, np.uint64)
        self.word.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.word).reshape(blocks, 4)
        within = np.zeros((blocks, 4), np.uint8)
        np.cumsum(ones[:, :3], axis=1, out=within[:, 1:])
        self.within = within.ravel()
        self.before = np.zeros(blocks, np.int32)
        np.cumsum(ones[:-1].sum(axis=1, dtype=np.int32), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i entries."""
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 2] + self.within[at] + np.bitwise_count(self.word[at] & below)

    @property
    def nbytes(self) -> int:
        return self.word.nbytes + self.within.nbytes + self.before.nbytes


class WaveletMatrix:
    """Rank queries over a sequence of numbers; one bit vector for each bit of them."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(seq)
        self.levels, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(self.n - int(bit.sum()))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first i entries' symbols of this kind end in the last level."""
        for level in range(self.bits):
            one = self.levels[level].ones(i)
            i = np.where(symbol >> (self.bits - 1 - level) & 1, self.zeros[level] + one, i - one)
        return i

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """symbol, and its bounds in the last level, for every symbol that occurs in each range."""
        symbol = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            a, b = self.levels[level].ones(lo), self.levels[level].ones(hi)
            left, right = (hi - b) > (lo - a), b > a
            z = self.zeros[level]
            symbol = np.concatenate((symbol[left] << 1, symbol[right] << 1 | 1))
            lo, hi = np.concatenate(((lo - a)[left], (z + a)[right])), np.concatenate(((hi - b)[left], (z + b)[right]))
        return symbol, lo, hi


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code for symbols that occur so often; at least 1."""
    if len(counts) == 1:
        return np.ones(1, np.int64)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up = np.zeros(2 * len(counts) - 1, np.int64)
    for node in range(len(counts), 2 * len(counts) - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x] = up[y] = node
        heapq.heappush(heap, (a + b, node))
    depth = np.zeros(len(up), np.int64)
    for node in range(len(up) - 2, -1, -1):
        depth[node] = depth[up[node]] + 1
    return depth[: len(counts)]


class HuffmanMatrix:
    """Rank queries over a sequence of numbers 0..sigma-1, in as many bits as an optimal prefix code takes.

    Level by level the entries are parted by their code's next bit, zeros first. Codes are given out so that those that
    end with a level are the last there, so the entries that go on stay together, and no place has to be corrected."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        counts = np.bincount(seq, minlength=sigma)
        some = np.flatnonzero(counts)
        self.length = np.zeros(sigma, np.int64)
        self.length[some] = code_lengths(counts[some])
        self.code = np.zeros(sigma, np.uint64)  # the first bit lowest
        open_ = np.zeros(1, np.uint64)  # codes not given out, in the order in which a level has them
        order = some[np.argsort(self.length[some], kind="stable")]
        ends = np.searchsorted(self.length[order], np.arange(int(self.length.max(initial=0)) + 2))
        for n in range(1, len(ends) - 1):
            open_ = np.concatenate((open_, open_ | np.uint64(1) << np.uint64(n - 1)))
            own = order[ends[n] : ends[n + 1]]
            if len(own):
                self.code[own] = open_[len(open_) - len(own) :]
                open_ = open_[: len(open_) - len(own)]
        self.levels, self.zeros = [], []
        level = 0
        while len(seq):
            bit = (self.code[seq] >> np.uint64(level) & np.uint64(1)).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate((seq[~bit], seq[bit]))
            level += 1
            seq = seq[self.length[seq] > level]

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first i entries' symbols of this kind end in the level with which their code ends."""
        i = i.copy()
        code, length = self.code[symbol], self.length[symbol]
        live = np.arange(len(symbol))
        for level in range(len(self.levels)):
            live = live[length[live] > level]
            if not len(live):
                break
            one = self.levels[level].ones(i[live])
            i[live] = np.where((code[live] >> np.uint64(level) & np.uint64(1)).astype(bool), self.zeros[level] + one, i[live] - one)
        return i

    @property
    def nbytes(self) -> int:
        return sum(b.nbytes for b in self.levels) + self.code.nbytes + self.length.nbytes


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys that leave so many bits for a number, and the sorted keys; 0: keys take all bits."""
    if not bits:
        order = np.argsort(key)
        return order, key[order]
    both = np.sort(key << bits | np.arange(len(key)))
    return both & (1 << bits) - 1, both >> bits


class Suffixes:
    """The order of all suffixes of segments, each closed by a mark of its own that sorts before all symbols, in the
    segments' order. text, sa, rank: all units, in 32 bits."""

    def __init__(self, code: np.ndarray, size: np.ndarray, depth: int) -> None:
        """code: all segments' symbols one after the other. same() tells rows of equal first `depth` symbols."""
        if code.dtype == np.uint8:
            used = np.bincount(code, minlength=256) > 0
            alphabet, dense = np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - 1)[code]
        else:
            alphabet, dense = np.unique(code, return_inverse=True)
        self.sigma = len(alphabet) + 1
        n = len(code) + len(size)
        if n >= 1 << 31:
            raise ValueError("an index holds up to 2^31 units")
        ends = np.cumsum(size + 1) - 1  # of the marks
        text = np.zeros(n, np.int32)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = dense + 1
        self.text, self.n, self.marks = text, n, len(size)
        self.start = ends - size
        number = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
        left = (ends[number] - np.arange(n)).astype(np.int32)  # symbols before the mark
        self.bits = max(1, int(self.sigma - 1).bit_length())
        wide = n.bit_length()
        packed = 3 * (n + len(size)).bit_length() <= 63  # two ranks and a number in one key: sorting these beats argsort
        pack = min(depth, max(1, (63 - wide if packed else 62) // self.bits))
        # the first `pack` symbols of each suffix as one number, from its first 1, 2, 4, ... symbols; zeros behind a mark
        key, done, span = np.zeros(n, np.int64), 0, 1
        power = text.astype(np.int64)

        def append(head: np.ndarray, m: int, tail: np.ndarray, width: int) -> np.ndarray:
            """The first m symbols with the `width` symbols behind them."""
            out = head << width * self.bits
            out[: n - m] |= np.where(left[: n - m] >= m, tail[m:], 0)
            return out

        while span <= pack:
            if pack & span:
                key, done = append(key, done, power, span) if done else power, done + span
            if 2 * span <= pack:
                power = append(power, span, power, span)
            span *= 2
        # suffixes that reach their mark within the first h symbols are told apart by the number of their segment
        h = pack
        order, k = _sorted(key, wide if packed else 0)
        ended = left[order] < h
        short = np.flatnonzero(ended)  # equal keys of these: in the order of segments
        order[short] = order[short][np.lexsort((order[short], k[short]))]
        new = np.ones(n, bool)
        new[1:] = (k[1:] != k[:-1]) | ended[1:]
        del key, k, power
        begin = np.flatnonzero(new)
        size_of = np.diff(np.append(begin, n))
        rank = np.empty(n, np.int32)  # suffixes that are smaller in their first h symbols
        rank[order] = np.repeat(begin, size_of)
        open_ = order[np.repeat(size_of > 1, size_of)]
        del order
        self.at_depth = (h, rank.copy())
        while len(open_):  # doubling, on suffixes that still tie only
            then = np.where(left[open_] < h, number[open_], len(size) + rank[np.minimum(open_ + h, n - 1)].astype(np.int64))
            both = (n + len(size)).bit_length()
            order, key = _sorted(rank[open_].astype(np.int64) << (both if packed else 32) | then, len(open_).bit_length() if packed else 0)
            open_ = open_[order]
            own, at = rank[open_], np.arange(len(open_))
            run, group = np.ones(len(open_), bool), np.ones(len(open_), bool)
            run[1:], group[1:] = key[1:] != key[:-1], own[1:] != own[:-1]
            rank[open_] = own + np.maximum.accumulate(np.where(run, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            single = run.copy()
            single[:-1] &= run[1:]
            open_ = open_[~single]
            h *= 2
            if h <= depth:
                self.at_depth = (h, rank.copy())
        self.rank = rank
        self.sa = np.empty(n, np.int32)
        self.sa[rank] = np.arange(n, dtype=np.int32)
        self.left = left

    def before(self) -> np.ndarray:
        """The transform: the symbol before each row's suffix, 0 for a mark."""
        text = self.text if self.sigma > 256 else self.text.astype(np.uint8)
        return np.where(self.sa > 0, text[self.sa - 1], text.dtype.type(0))

    def first(self) -> np.ndarray:
        """Rows before those that begin with each symbol."""
        out = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(self.text, minlength=self.sigma), out=out[1:])
        return out

    def same(self, length: int) -> np.ndarray:
        """For each row but the first, whether it shares its first `length` symbols (depth at most) with the row before."""
        h, rank = self.at_depth
        prev, own = self.sa[:-1], self.sa[1:]
        out = (self.left[prev] >= length) & (self.left[own] >= length) & (rank[prev] == rank[own])
        i = np.flatnonzero(out)
        out[i] = rank[prev[i] + length - h] == rank[own[i] + length - h]
        return out


class Bwt(Suffixes):
    """The transform in a wavelet matrix, beside the suffix order."""

    def __init__(self, code: np.ndarray, size: np.ndarray, depth: int) -> None:
        super().__init__(code, size, depth)
        before = self.before()
        self.symbol = before.astype(np.uint8 if self.sigma <= 256 else np.uint16 if self.sigma <= 65536 else np.int32)
        self.tree = WaveletMatrix(before, self.bits)
        self.first_row = self.first()
        symbols = np.arange(self.sigma)
        self.shift = self.first_row[:-1] - self.tree.down(symbols, np.zeros(self.sigma, np.int64))

    def steps(self) -> np.ndarray:
        """The row of the suffix one symbol longer, for each row; rows before which a mark stands lead to -1."""
        out = np.empty(self.n, np.int32)
        out[np.argsort(self.symbol, kind="stable")] = np.arange(self.n, dtype=np.int32)
        out[self.symbol == 0] = -1
        return out


class FmIndex:
    """A compressed index of segments: the transform in a Huffman-shaped wavelet matrix, counts of symbols, and the
    intervals of strings of `length` symbols that stand at several places, each with its earliest place. Neither text
    nor suffix order is kept; a string at one place only needs no entry, as its place is the one it is asked from."""

    def __init__(self, code: np.ndarray, size: np.ndarray, place: np.ndarray, length: int) -> None:
        s = Suffixes(code, size, length)
        self.n, self.sigma = s.n, s.sigma
        self.row = s.first()
        same = s.same(length)
        inner = np.concatenate(([False], same))  # rows that go on an interval
        head = np.flatnonzero(np.concatenate((~inner[:-1] & inner[1:], [False])))
        self.head = Bits(np.isin(np.arange(s.n), head, assume_unique=True) if len(head) else np.zeros(s.n, bool))
        stop = np.flatnonzero(inner & np.concatenate((~inner[1:], [True]))) + 1
        self.begin, self.end = head.astype(np.int32), stop.astype(np.int32)
        whole = np.full(s.n, np.iinfo(np.int64).max)
        whole[np.arange(len(place)) + np.repeat(np.arange(len(size)), size)] = place
        self.earliest = np.minimum.reduceat(np.append(whole[s.sa], np.iinfo(np.int64).max), np.stack([head, stop], axis=1).ravel())[::2] if len(head) else np.empty(0, np.int64)
        self.tree = HuffmanMatrix(s.before(), s.sigma)
        del s
        symbols = np.arange(self.sigma)
        self.shift = self.row[:-1] - self.tree.down(symbols, np.zeros(self.sigma, np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the strings symbol + w, from the rows of the strings w."""
        both = self.tree.down(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        return self.shift[symbol] + both[: len(lo)], self.shift[symbol] + both[len(lo) :]

    def shared(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row's string of `length` symbols stands at several places, and the number of its interval."""
        g = self.head.ones(row + 1) - 1
        return (g >= 0) & (row < self.end[g]) if len(self.end) else np.zeros(len(row), bool), g

    @property
    def nbytes(self) -> int:
        return self.tree.nbytes + self.head.nbytes + sum(x.nbytes for x in (self.row, self.shift, self.begin, self.end, self.earliest))
