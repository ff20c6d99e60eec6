"""The smallest delta of chunks over all their candidates, on numpy arrays: no pair of chunks is a row anywhere.

Chunks stand in groups, and every earlier chunk of a group is a candidate. A delta copies only where a block of the
base is found in the target, so all bases without such a block give the same delta, and only the first of them counts.
The others are met through a sorted table of blocks. Their runs are found for many pairs at once, and bases that give a
target the same runs give it the same delta: the first of them is packed, the others are not."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from chunkloom.operators import codec

STEP = codec.STEP
#: Matches of blocks that are looked through at once, and bits of the table that says which blocks cannot be there.
HITS, TABLE_BITS = 1 << 20, 22
#: Bytes of targets that are looked up at once, and of small groups that share a table.
BATCH = 1 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_ONE = np.uint64(1)


class _Rows:
    """Chunks one behind the other; words: the eight bytes from any place on."""

    def __init__(self, group: list[int], ids: list[int], data: list[bytes]) -> None:
        self.group, self.ids, self.data = np.array(group, np.int64), np.array(ids, np.int64), data
        self.size = np.fromiter(map(len, data), np.int64, len(data))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(data) + bytes(2 * STEP), np.uint8)
        self.words = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))

    def keys(self, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of the blocks from these places on, with the number of the group."""
        x = self.words[place] * _A
        x ^= x >> np.uint64(32)
        x += self.words[place + 8] + self.group[owner].astype(np.uint64) * _C
        x *= _B
        x ^= x >> np.uint64(29)
        x *= _A
        return x ^ (x >> np.uint64(32))


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each entry's row, and its number there."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - (np.cumsum(count) - count)[owner]


class Bases(_Rows):
    """Chunks in the order of their groups and ids, and a table of their blocks."""

    def __init__(self, group: list[int], ids: list[int], data: list[bytes]) -> None:
        super().__init__(group, ids, data)
        owner, nth = _spread(self.size // STEP)
        key = self.keys(owner, self.start[owner] + nth * STEP)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        keep = np.ones(len(key), bool)  # of a chunk's equal blocks the first
        keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, self.owner, self.place = key[keep], owner[keep], nth[order][keep] * STEP
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        self.key, self.begin = key[first], np.append(first, len(key))
        self.some = np.zeros(1 << TABLE_BITS, bool)
        self.some[self.key >> np.uint64(64 - TABLE_BITS)] = True

    def smallest(self, group: list[int], ids: list[int], data: list[bytes]) -> tuple[list[int], list[int], list[int]]:
        """chunk, size of its smallest delta, base (of equal sizes the first); targets without an earlier chunk are left out."""
        q = _Rows(group, ids, data)
        low = np.searchsorted(self.group, q.group)
        # bases before each target in the order of groups and ids
        order = np.lexsort((np.concatenate((q.ids, self.ids)), np.concatenate((q.group, self.group))))
        is_base = order >= len(q.ids)
        upto = np.empty(len(order), np.int64)
        upto[order] = np.cumsum(is_base)
        upto = upto[: len(q.ids)]
        best: list[tuple[int, int] | None] = [None] * len(data)
        near = np.zeros(len(data), np.int64)  # leading chunks of the group with a common block, one behind the other
        owner, at = _spread(np.maximum(q.size - STEP + 1, 0))
        key = q.keys(owner, q.start[owner] + at)
        some = self.some[key >> np.uint64(64 - TABLE_BITS)]
        owner, at, key = owner[some], at[some], key[some]
        found = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        some = self.key[found] == key if len(self.key) else np.zeros(0, bool)
        owner, at, found = owner[some], at[some], found[some]
        count = self.begin[found + 1] - self.begin[found]
        hits = np.concatenate(([0], np.cumsum(np.bincount(owner, count, len(data)).astype(np.int64))))
        lo = 0
        while lo < len(data):
            hi = max(lo + 1, int(np.searchsorted(hits, hits[lo] + HITS, "right")) - 1)
            a, b = np.searchsorted(owner, [lo, hi])
            if a < b:
                self._through(q, owner[a:b], at[a:b], self.begin[found[a:b]], count[a:b], low, upto, best, near)
            lo = hi
        out = []
        for i in range(len(data)):
            apart = int(low[i] + near[i])
            if apart < upto[i]:
                size = len(codec.pack([(-1, len(data[i]), 0)] if data[i] else [], data[i]))
                got = (size, int(self.ids[apart]))
                if best[i] is None or got < best[i]:
                    best[i] = got
            if best[i] is not None:
                out.append((ids[i], *best[i]))
        return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])

    def _through(self, q: _Rows, owner: np.ndarray, at: np.ndarray, begin: np.ndarray, count: np.ndarray, low: np.ndarray, upto: np.ndarray, best: list, near: np.ndarray) -> None:
        """Pairs of some targets with the chunks that hold a block of theirs."""
        row, nth = _spread(count)
        entry = begin[row] + nth
        t, pos, base, src = owner[row], at[row], self.owner[entry], self.place[entry]
        p, s = q.start[t] + pos, self.start[base] + src
        true = (base >= low[t]) & (base < upto[t]) & (q.words[p] == self.words[s]) & (q.words[p + 8] == self.words[s + 8])
        t, pos, base, src = t[true], pos[true], base[true], src[true]
        if not len(t):
            return
        order = np.argsort(t * len(self.ids) + base, kind="stable")  # places stay in order
        t, pos, base, src = t[order], pos[order], base[order], src[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (base[1:] != base[:-1])
        ptr = np.flatnonzero(new)
        stop = np.append(ptr[1:], len(t))
        line = (np.cumsum(new) - 1) << 32 | pos
        pt, pb = t[ptr], base[ptr]
        rank = np.arange(len(pt)) - np.searchsorted(pt, pt)
        near += np.bincount(pt, pb == low[pt] + rank, len(near)).astype(np.int64)
        lit, one, two = np.zeros(len(pt), np.int64), np.zeros(len(pt), np.uint64), np.zeros(len(pt), np.uint64)
        live, runs = np.arange(len(pt)), []
        while len(live):
            i = ptr[live]
            begin_, size, place = self._grown(q, t[i], pos[i], base[i], src[i], lit[live])
            runs.append((live, begin_, size, place))
            word = (begin_ << 40 ^ size << 20 ^ place).astype(np.uint64) * _A
            word ^= word >> np.uint64(31)
            one[live] = (one[live] + word) * _B
            two[live] = (two[live] ^ word) * _C + word + _ONE
            lit[live] = begin_ + size
            ptr[live] = np.searchsorted(line, live << 32 | lit[live])
            live = live[ptr[live] < stop[live]]
        order = np.lexsort((two, one, pt))
        o, w, z = pt[order], one[order], two[order]
        first = np.ones(len(order), bool)
        first[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1]) | (z[1:] != z[:-1])
        chosen = np.zeros(len(pt), bool)
        chosen[order[first]] = True
        pair, begin_, size, place = (np.concatenate(x) for x in zip(*runs, strict=True))
        some = chosen[pair]
        pair, begin_, size, place = pair[some], begin_[some], size[some], place[some]
        order = np.argsort(pair, kind="stable")
        pair, begin_, size, place = (x[order].tolist() for x in (pair, begin_, size, place))
        pt, of, i = pt.tolist(), self.ids[pb].tolist(), 0
        while i < len(pair):
            n = pair[i]
            target, ops, added, done = q.data[pt[n]], [], [], 0
            while i < len(pair) and pair[i] == n:
                if begin_[i] > done:
                    ops += (-1, begin_[i] - done)
                    added.append(target[done : begin_[i]])
                ops += (place[i], size[i])
                done = begin_[i] + size[i]
                i += 1
            if done < len(target):
                ops += (-1, len(target) - done)
                added.append(target[done:])
            got = (4 + len(zlib.compress(struct.pack("<" + "iI" * (len(ops) // 2), *ops) + b"".join(added), 6)), of[n])
            if best[pt[n]] is None or got < best[pt[n]]:
                best[pt[n]] = got

    def _grown(self, q: _Rows, t: np.ndarray, pos: np.ndarray, base: np.ndarray, src: np.ndarray, lit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of a block grown both ways: begin in the target, size, begin in the base."""
        p, s = q.start[t] + pos, self.start[base] + src
        back, room = np.zeros(len(t), np.int64), np.minimum(pos - lit, src)
        live = np.flatnonzero(room > 0)
        while len(live):
            live = live[q.bytes[p[live] - back[live] - 1] == self.bytes[s[live] - back[live] - 1]]
            back[live] += 1
            live = live[back[live] < room[live]]
        size, room = np.full(len(t), STEP), np.minimum(q.size[t] - pos, self.size[base] - src)
        live = np.flatnonzero(room > STEP)
        while len(live):
            x = q.words[p[live] + size[live]] ^ self.words[s[live] + size[live]]
            equal = np.where(x == 0, 8, np.bitwise_count((x & (~x + _ONE)) - _ONE) >> 3).astype(np.int64)
            size[live] = np.minimum(size[live] + equal, room[live])
            live = live[(equal == 8) & (size[live] < room[live])]
        return pos - back, size + back, src - back


def smallest_deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk_id, d, base_id of the targets of each cell. Rows (sf, slab, deal: the cell; target, chunk_id, payload) come
    in this order, so bases come before targets. Small cells are looked through together; targets of large ones, in parts."""
    cell, number, table = None, -1, None
    bases: tuple[list, list, list] = ([], [], [])
    targets: tuple[list, list, list] = ([], [], [])
    held = waiting = 0

    def decided() -> pa.RecordBatch:
        nonlocal table, waiting
        table = table or Bases(*bases)
        out = table.smallest(*targets)
        for x in targets:
            x.clear()
        waiting = 0
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["chunk_id", "d", "base_id"])

    for b in batches:
        for *now, target, chunk, data in zip(*(b.column(x).to_pylist() for x in ("sf", "slab", "deal", "target", "chunk_id", "payload")), strict=True):
            if now != cell:
                if table is not None or held + waiting > BATCH:
                    if targets[0]:
                        yield decided()
                    for x in bases:
                        x.clear()
                    table, held = None, 0
                cell, number = now, number + 1
            rows = targets if target else bases
            for x, v in zip(rows, (number, chunk, data), strict=True):
                x.append(v)
            if not target:
                held += len(data)
            else:
                waiting += len(data)
                if waiting > BATCH:
                    yield decided()
    if targets[0]:
        yield decided()
