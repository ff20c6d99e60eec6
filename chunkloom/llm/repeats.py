"""Windows of L units (words or bytes) that start earlier too: what substring dedup and suffix-array dedup share.

A window's anchor is the smallest of its k-grams, in an order that puts k-grams frequent in the corpus last (from a
table of counts of fixed size, over all texts) and is random otherwise. Equal windows have equal anchors, so:

1. an anchor that stands at one place only settles its windows: nothing repeats. A bitmap of fixed size holds the
   others.
2. runs of windows with one anchor from the bitmap are segments. Map tasks send each distinct segment, with its first
   occurrence, to the shard of its anchor: a passage that fills a third of all texts is there once for each task.
3. a shard indexes its distinct segments, and the index (FM-index or BWT intervals, given by the caller) tells each
   window's first occurrence. A segment's first occurrence may keep windows; its other occurrences keep none.
4. documents meet the windows that they keep, and all other windows of repeated anchors go.

When the bitmap fills up, more segments go to shards; results stay the same. Shards are sized by the anchors found.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import cut, fan_out, lean, sliced, unused
from chunkloom.llm.packed import BYTE_CODES, STEP, STEP_BACK, Words, column_bytes, powers, scramble, sliding_min

SKETCH_BITS, BITMAP_BITS, CHUNKS = 21, 27, 64
#: Windows in a segment at most. Units of text in a shard, about.
RUN, SHARD_UNITS = 64, 750_000
SLICE = 1 << 18
NO_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Unit:
    words: bool
    length: int  # L
    gram: int  # k

    @property
    def grams(self) -> int:
        return self.length - self.gram + 1


class Units:
    """Codes of all units of some texts, their texts' bounds, and k-gram hashes."""

    def __init__(self, column: pa.Array, unit: Unit) -> None:
        self.unit = unit
        self.data, self.offsets = column_bytes(column)
        if unit.words:
            self.words = Words(self.data, self.offsets)
            self.code, self.first = self.words.hash, self.words.first
        else:
            self.code, self.first = self.data, self.offsets
        n = len(self.code)
        each = self.code if unit.words else BYTE_CODES[self.code]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(each * powers(STEP, n), out=self.sums[1:])

    def span_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return scramble((self.sums[stop] - self.sums[start]) * powers(STEP_BACK, len(self.code) + 1)[start] + (stop - start).astype(np.uint64))

    def grams(self) -> np.ndarray:
        """Hash of the k units from each on; those that reach into the next text are there too."""
        k, n = self.unit.gram, len(self.code)
        if n < k:
            return np.empty(0, np.uint64)
        return scramble((self.sums[k:] - self.sums[: n - k + 1]) * powers(STEP_BACK, n + 1)[: n - k + 1])

    def inside(self, length: int) -> np.ndarray:
        """Whether `length` units from each on are of one text."""
        n = len(self.code)
        out = np.ones(max(0, n - length + 1), bool)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, self.first[1:-1], 1)
        text = np.cumsum(edge[:n])
        if n >= length:
            out = text[length - 1 :] == text[: n - length + 1]
        return out

    def _minima(self, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ordered k-grams, each window's smallest one, and whether the window lies in one text."""
        g = self.grams()
        g = levels[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | g >> np.uint64(8)
        return g, sliding_min(g, self.unit.grams), self.inside(self.unit.length)

    def anchors(self, levels: np.ndarray) -> np.ndarray:
        """The k-grams that are the smallest of some window, once for each place where they stand."""
        w = self.unit.grams
        if len(self.code) < self.unit.length:
            return np.empty(0, np.uint64)
        g, m, ok = self._minima(levels)
        high = np.uint64((1 << 64) - 1)
        upside = np.full(len(m) + 2 * (w - 1), high)  # the largest of the minima of all windows with a k-gram, by their complement
        upside[w - 1 : w - 1 + len(m)] = np.where(ok, high - m, high)
        return g[high - sliding_min(upside, w) == g]

    def segments(self, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, windows, anchor of each segment."""
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        if len(self.code) < self.unit.length:
            return none
        _, m, ok = self._minima(levels)
        at = np.flatnonzero(ok)
        if not len(at):
            return none
        a = m[at]
        owner = np.searchsorted(self.first, at, "right")
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        run = np.diff(np.append(begin, len(at)))
        parts = -(-run // RUN)
        head = np.repeat(begin, parts)
        nth = np.arange(len(head)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = head + nth * RUN
        return at[start], np.minimum(np.repeat(run, parts) - nth * RUN, RUN), a[start]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _sum_chunks(rows: DataFrame) -> np.ndarray:
    """The levels of a table of counts sent in CHUNKS parts; fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
                sums[part] = sums[part] + x if part in sums else x
        packed = [zlib.compress(np.minimum(np.log2(np.maximum(x, 1).astype(np.float64)), 63).astype(np.uint8).tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "data": pa.array(packed, pa.binary())})

    out = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.uint8)
    for r in rows.repartition(12, "part").mapInArrow(lean(add), "part int, data binary").collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint8)
    return out.ravel()


def gram_levels(docs: DataFrame, unit: Unit) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                u = Units(b.column("text"), unit)
                g = u.grams()
                g = g[u.inside(unit.gram)[: len(g)]]
                np.add.at(table, (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        parts = np.minimum(table, (1 << 32) - 1).astype(np.uint32).reshape(CHUNKS, -1)
        some = [i for i in range(CHUNKS) if parts[i].any()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "data": pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())})

    return _sum_chunks(_texts(docs).mapInArrow(lean(run), "part int, data binary"))


def _bit(anchor: np.ndarray) -> np.ndarray:
    return (scramble(anchor) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def repeated_anchors(docs: DataFrame, unit: Unit, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """The packed bitmap of anchors that stand at several places, and how many there are."""
    width = 1 << 19  # bits of the bitmap in a bucket
    buckets = (1 << BITMAP_BITS) // width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            a, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = _bit(a) // width
            order = np.argsort(bucket, kind="stable")
            a, n = a[order], n[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            data = [a[cuts[i] : cuts[i + 1]].tobytes() for i in some]
            often = [np.packbits(n[cuts[i] : cuts[i + 1]] > 1).tobytes() for i in some]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "data": pa.array(data, pa.binary()), "often": pa.array(often, pa.binary())})

        size = 0
        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                a = Units(b.column("text"), unit).anchors(levels)
                held.append(a)
                size += len(a)
                if size > 1 << 21:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, twice = None, [], []

        def one() -> pa.RecordBatch:
            a, t = np.concatenate(held), np.concatenate(twice)
            order = np.argsort(a)
            a, t = a[order], t[order]
            edge = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            many = (np.diff(np.append(edge, len(a))) > 1) | np.maximum.reduceat(t, edge)
            bits = np.zeros(width, np.uint8)
            bits[_bit(a[edge[many]]) - bucket * width] = 1
            held.clear()
            twice.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([int(many.sum())], pa.int64()), "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})

        for b in batches:
            for i, raw, often in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), b.column("often").to_pylist(), strict=True):
                if i != bucket and held:
                    yield one()
                bucket = i
                x = np.frombuffer(raw, np.uint64)
                held.append(x)
                twice.append(np.unpackbits(np.frombuffer(often, np.uint8), count=len(x)).astype(bool))
        if held:
            yield one()

    sent = _texts(docs).mapInArrow(lean(run), "bucket int, data binary, often binary")
    rows = sent.repartition(fan_out(docs), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "bucket int, n long, bits binary").collect()
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in rows:  # at most `buckets` rows of fixed size
        bitmap[r["bucket"] * width // 8 : (r["bucket"] + 1) * width // 8] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return bitmap, sum(r["n"] for r in rows)


def _chosen(units: Units, levels: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, count, anchor = units.segments(levels)
    bit = _bit(anchor)
    ok = (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
    return start[ok], count[ok], anchor[ok]


def _place_key(doc: np.ndarray, pos: np.ndarray, name: np.ndarray) -> np.ndarray:
    """A 64-bit name of one occurrence of one segment."""
    return scramble(scramble(doc.astype(np.uint64) * STEP + pos.astype(np.uint64)) ^ name)


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


class Segments:
    """Distinct segments with their first occurrence."""

    def __init__(self, name: np.ndarray, doc: np.ndarray, pos: np.ndarray, count: np.ndarray, shard: np.ndarray, size: np.ndarray, code: np.ndarray) -> None:
        self.name, self.doc, self.pos, self.count, self.shard, self.size, self.code = name, doc, pos, count, shard, size, code

    @staticmethod
    def joined(parts: list[Segments]) -> Segments:
        return Segments(*(np.concatenate([getattr(p, a) for p in parts]) for a in ("name", "doc", "pos", "count", "shard", "size", "code")))

    def take(self, rows: np.ndarray) -> Segments:
        start = np.cumsum(self.size) - self.size
        return Segments(self.name[rows], self.doc[rows], self.pos[rows], self.count[rows], self.shard[rows], self.size[rows], _gather(self.code, start[rows], self.size[rows]))

    def distinct(self) -> Segments:
        order = np.lexsort((self.pos, self.doc, self.name))
        name = self.name[order]
        return self.take(order[np.concatenate(([True], name[1:] != name[:-1]))] if len(order) else order)

    def pack(self) -> bytes:
        head = b"".join((self.name.tobytes(), self.doc.tobytes(), self.pos.astype(np.int64).tobytes(), self.count.astype(np.uint8).tobytes()))
        return len(self.name).to_bytes(8, "little") + zlib.compress(head + self.code.tobytes(), 1)

    @staticmethod
    def unpack(raw: bytes, unit: Unit, shard: int) -> Segments:
        m, data = int.from_bytes(raw[:8], "little"), zlib.decompress(raw[8:])
        name, doc, pos = (np.frombuffer(data, t, m, 8 * m * i) for i, t in enumerate((np.uint64, np.int64, np.int64)))
        count = np.frombuffer(data, np.uint8, m, 24 * m).astype(np.int64)
        return Segments(name, doc, pos, count, np.full(m, shard), count + unit.length - 1, np.frombuffer(data, np.uint64 if unit.words else np.uint8, -1, 25 * m))


#: codes of all segments one after the other, their sizes and window counts, and the place of each unit (a whole number
#: that orders places in documents) -> the first place of each unit's window; windows in the order of segments.
Index = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def kept_windows(docs: DataFrame, unit: Unit, levels: np.ndarray, bitmap: np.ndarray, shards: int, index: Index, doc_buckets: int) -> DataFrame:
    """bucket, data: for documents of each bucket, names of segment occurrences and masks of the windows that they keep."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Segments] = []
        size = 0

        def flush() -> pa.RecordBatch:
            s = Segments.joined(held).distinct()
            held.clear()
            order = np.argsort(s.shard, kind="stable")
            s = s.take(order)
            some, cuts = np.unique(s.shard, return_index=True)
            cuts = [*cuts, len(s.shard)]
            data = [s.take(np.arange(cuts[i], cuts[i + 1])).pack() if len(some) > 1 else s.pack() for i in range(len(some))] if len(some) < 64 else list(_split(s, cuts))
            return pa.RecordBatch.from_pydict({"shard": pa.array(some, pa.int32()), "data": pa.array(data, pa.binary())})

        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                u = Units(b.column("text"), unit)
                start, count, anchor = _chosen(u, levels, bitmap)
                if not len(start):
                    continue
                ids = b.column("doc_id").fill_null(NO_ID).to_numpy()
                text = np.searchsorted(u.first, start, "right") - 1
                n = count + unit.length - 1
                shard = (scramble(anchor ^ STEP) >> np.uint64(33)).astype(np.int64) % shards
                name = u.span_hash(start, start + n)
                doc, pos = ids[text], start - u.first[text]
                order = np.lexsort((pos, doc, name))
                first = order[np.concatenate(([True], name[order][1:] != name[order][:-1]))]
                held.append(Segments(name[first], doc[first], pos[first], count[first], shard[first], n[first], _gather(u.code, start[first], n[first])))
                size += held[-1].code.nbytes + 40 * len(first)
                if size > 24 << 20:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def one() -> pa.RecordBatch:
            s = Segments.joined(held).distinct()
            held.clear()
            docs_, rank = np.unique(s.doc, return_inverse=True)
            begin = np.cumsum(s.size) - s.size
            place = (rank.astype(np.int64) << 40)[np.repeat(np.arange(len(s.size)), s.size)] + np.repeat(s.pos - begin, s.size) + np.arange(len(s.code))
            first = index(s.code, s.size, s.count, place, unit.length)
            own = _gather(place, begin, s.count)
            keep = first == own
            begin = np.cumsum(s.count) - s.count
            nth = (np.arange(len(keep)) - np.repeat(begin, s.count)).astype(np.uint64)
            masks = np.bitwise_or.reduceat(np.where(keep, np.uint64(1) << nth, np.uint64(0)), begin)
            some = np.flatnonzero(masks)
            key, masks, doc = _place_key(s.doc[some], s.pos[some], s.name[some]), masks[some], s.doc[some]
            bucket = doc_bucket(doc, doc_buckets)
            order = np.argsort(bucket, kind="stable")
            to, cuts = np.unique(bucket[order], return_index=True)
            cuts = [*cuts, len(order)]
            data = [key[o].tobytes() + masks[o].tobytes() for o in (order[cuts[i] : cuts[i + 1]] for i in range(len(to)))]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(to, pa.int32()), "data": pa.array(data, pa.binary())})

        for b in batches:
            for i, raw in zip(b.column("shard").to_pylist(), b.column("data").to_pylist(), strict=True):
                if i != shard and held:
                    yield one()
                shard = i
                held.append(Segments.unpack(raw, unit, i))
        if held:
            yield one()

    sent = _texts(docs).mapInArrow(lean(send), "shard int, data binary")
    return sent.repartition(min(shards, 4 * fan_out(docs)), "shard").sortWithinPartitions("shard").mapInArrow(lean(settle), "bucket int, data binary")


def _split(s: Segments, cuts: list[int]) -> Iterator[bytes]:
    ends = np.concatenate(([0], np.cumsum(s.size)))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield Segments(s.name[lo:hi], s.doc[lo:hi], s.pos[lo:hi], s.count[lo:hi], s.shard[lo:hi], s.size[lo:hi], s.code[ends[lo] : ends[hi]]).pack()


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (scramble(doc.astype(np.uint64) + np.uint64(77)) >> np.uint64(33)).astype(np.int64) % buckets


#: batch of documents, its units, and for each unit whether it goes -> what to return
Finish = Callable[[pa.RecordBatch, Units, np.ndarray], pa.RecordBatch]


def remove_repeats(docs: DataFrame, unit: Unit, index: Index, finish: Finish, schema: str) -> DataFrame:
    """Applies finish to all documents (all columns of docs), each with the mask of its units in repeated windows."""
    levels = gram_levels(docs, unit)
    bitmap, anchors = repeated_anchors(docs, unit, levels)
    shards = max(fan_out(docs), int(anchors * 1.5 * (unit.length + unit.grams // 2)) // SHARD_UNITS)
    doc_buckets = 4 * fan_out(docs)
    kept = cut(kept_windows(docs, unit, levels, bitmap, shards, index, doc_buckets))
    names = docs.columns
    bucket_col, tag_col, data_col = unused(names, "bucket", "tag", "data")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
            extra = {bucket_col: pa.array(doc_bucket(ids, doc_buckets), pa.int32()), tag_col: pa.array(np.ones(len(ids), np.int32)), data_col: pa.nulls(len(ids), pa.binary())}
            yield pa.RecordBatch.from_arrays([*b.columns, *extra.values()], [*names, *extra])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    tagged = docs.mapInArrow(lean(place), f"{shape}, `{bucket_col}` int, `{tag_col}` int, `{data_col}` binary")
    marks = kept.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields], F.col("bucket").alias(bucket_col), F.lit(0).alias(tag_col), F.col("data").alias(data_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, table = None, [], None
        for whole in batches:
            if not whole.num_rows:
                continue
            at, tag = whole.column(bucket_col).to_numpy(), whole.column(tag_col).to_numpy()
            edges = np.flatnonzero(np.diff(at) | np.diff(tag)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(at)], strict=True):
                if at[lo] != bucket:
                    bucket, parts, table = at[lo], [], None
                if not tag[lo]:
                    parts += whole.column(data_col).slice(lo, hi - lo).to_pylist()
                    continue
                if table is None:
                    pairs = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in parts]
                    table = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.uint64)
                    table = table[:, np.argsort(table[0])]
                for b in sliced(whole.slice(lo, hi - lo), "text", SLICE):
                    u = Units(b.column("text").cast(pa.string()), unit)
                    start, count, _ = _chosen(u, levels, bitmap)
                    gone = np.zeros(len(u.code) + 1, np.int64)
                    if len(start):
                        ids = b.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
                        text = np.searchsorted(u.first, start, "right") - 1
                        key = _place_key(ids[text], start - u.first[text], u.span_hash(start, start + count + unit.length - 1))
                        where = np.searchsorted(table[0], key)
                        where[where == table.shape[1]] = 0
                        mask = np.where(table[0][where] == key, table[1][where], np.uint64(0)) if table.shape[1] else np.zeros(len(key), np.uint64)
                        begin = np.cumsum(count) - count
                        nth = np.arange(int(count.sum())) - np.repeat(begin, count)
                        stay = (np.repeat(mask, count) >> nth.astype(np.uint64) & np.uint64(1)).astype(bool)
                        window = (np.repeat(start, count) + nth)[~stay]
                        gone[window] += 1  # windows of a slice are distinct
                        gone[window + unit.length] -= 1
                    yield finish(b.select(names), u, np.cumsum(gone[:-1]) > 0)

    both = tagged.unionByName(marks).repartition(2 * fan_out(docs), bucket_col).sortWithinPartitions(bucket_col, tag_col)
    return both.mapInArrow(lean(run), schema)
