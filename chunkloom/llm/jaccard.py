"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 0.8 or more, and their classes.

1. Each text becomes its set of shingles (64-bit hashes). Equal sets are one node from here on. A table of fixed size
   counts shingles over all texts; it gives one global order, rare first.
2. Prefix filter: two sets that link share a shingle among their n - ceil(0.8 n) + 1 rarest. Each map task packs its
   nodes' prefixes into one blob for each bucket of shingles.
3. Each bucket finds its shingles of several nodes. Pairs must pass the length filter and the positional filter. Small
   groups give all such pairs. In a large group each node pairs with a leader of like size only, and the group's
   members are kept: once the links found so far are known, members of different classes are paired too (step 5). As
   links within a class change nothing, no class is lost, and a group of n copies costs about n pairs. The nodes of a
   shingle with more than HOT places in the corpus are dealt over several buckets, and their leaders meet after that,
   so no task holds a whole group.
4. Distinct pairs pass the suffix filter (shingles counted by hash range bound the overlap), then are verified, once,
   on the whole sets of their texts. A node with many pairs is spread over several tasks.
5. Large groups that still hold several classes are searched across classes, with the suffix filter in finer ranges:
   first for pairs that likely link, at most one for each class to be joined, then for all pairs that are left.
   Members are dealt in blocks. A class that fills a block has blocks of its own, which meet those of other classes
   only: a class of n members and r others cost n * r / BLOCK rows, whatever n is. What was verified before is not
   verified again.

Defined results: null, empty or blank texts have n_shingles 0 and form a class each; texts of under five words have one
shingle, the whole sequence; rows that share a doc_id are each judged by their own text; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import cut, fan_out, lean, sliced
from chunkloom.llm.components import components
from chunkloom.llm.packed import STEP, Words, column_bytes, scramble

K = 5
#: The similarity as a fraction: links need 5 * overlap >= 4 * union.
NUM, DEN = 4, 5
SKETCH_BITS, CHUNKS = 23, 64
#: Groups up to this size give all their pairs at once. Pairs of a node that one task verifies. Bits of the node filter.
SMALL_GROUP, SPREAD, FILTER_BITS = 12, 1024, 23
BINS = 64
#: Ranges of the suffix filter within large groups; members of a group that one task holds (twice). Places of a shingle
#: in the corpus, by the table of counts, beyond which its nodes are dealt over several buckets.
FINE_BITS, BLOCK, HOT = 10, 4096, 1 << 16
FINE = 1 << FINE_BITS
#: Open groups and large classes in them, up to which their table (some MB) is sent to all tasks.
FEW_GROUPS = 50_000
SLICE = 1 << 18


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    w = Words(*column_bytes(column), lower=True)
    g, whole = w.grams(K)
    out = []
    for d in range(w.docs):
        lo, hi = w.first[d], w.first[d + 1]
        if hi - lo >= K:
            out.append(np.unique(g[lo : hi - K + 1]))
        elif hi > lo:
            x = np.zeros(1, np.uint64)
            for j in range(lo, hi):
                x = x * STEP + w.hash[j]
            out.append(scramble(x + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    if not len(s):
        return 0
    sums = np.array([scramble(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64), scramble(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)])
    return int((sums[:1] ^ sums[1:] * STEP).astype(np.int64)[0])


def need(n: np.ndarray) -> np.ndarray:
    return (NUM * n + DEN - 1) // DEN


def overlap_needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ceil(s * (a + b) / (1 + s))."""
    return (NUM * (a + b) + NUM + DEN - 1) // (NUM + DEN)


def histogram(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS).astype(np.uint16)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, node, bins of each row, and rows with part (0..CHUNKS-1) and counts of the frequency table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.uint32)
        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                sets = shingle_sets(b.column("text"))
                if sets:
                    np.add.at(table, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([
                    pa.array([-1] * n, pa.int32()), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.array([zlib.compress(histogram(s).tobytes(), 1) for s in sets], pa.binary())], ["part", "doc_id", "n", "node", "data"])
        parts = table.reshape(CHUNKS, -1)
        some = [i for i in range(CHUNKS) if parts[i].any()]
        null = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), null, null, null, pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())], ["part", "doc_id", "n", "node", "data"])

    return _texts(docs).mapInArrow(lean(run), "part int, doc_id long, n long, node long, data binary")


def frequency_levels(described: DataFrame) -> np.ndarray:
    """A level for each cell of the frequency table: four times the binary logarithm of its count. Fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
                sums[part] = sums[part] + x if part in sums else x
        levels = [zlib.compress(np.minimum(np.log2(np.maximum(x, 1).astype(np.float64)) * 4, 255).astype(np.uint8).tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "data": pa.array(levels, pa.binary())})

    out = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.uint8)
    for r in described.where("part >= 0").select("part", "data").repartition(12, "part").mapInArrow(lean(add), "part int, data binary").collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint8)
    return out.ravel()


def _pack(key: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray) -> bytes:
    small = np.stack([n, pos]).astype(np.uint32)
    tail = zlib.compress(np.ascontiguousarray(small.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
    return len(key).to_bytes(8, "little") + key.tobytes() + node.tobytes() + tail


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m = int.from_bytes(raw[:8], "little")
    key, node = np.frombuffer(raw, np.uint64, m, 8), np.frombuffer(raw, np.int64, m, 8 + 8 * m)
    small = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw[8 + 16 * m :]), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(2, m)
    return key, node, small[0].astype(np.int64), small[1].astype(np.int64)


def prefixes(docs: DataFrame, levels: np.ndarray, buckets: int) -> DataFrame:
    """bucket, data: the packed prefix entries (ordered shingle, node, n, position) of all distinct nodes of a task. A
    shingle's level is in its key, so that all tasks deal a frequent one's nodes over the same buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, node, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            parts = np.ceil(2.0 ** ((key >> np.uint64(56)).astype(np.float64) / 4) / HOT).astype(np.uint64)
            salt = np.where(parts > 1, scramble(node.astype(np.uint64)) % np.maximum(parts, 1), np.uint64(0))
            bucket = (scramble(key + salt * STEP) >> np.uint64(40)).astype(np.int64) % buckets
            order = np.lexsort((key, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            data = [_pack(*(x[order[cuts[i] : cuts[i + 1]]] for x in (key, node, n, pos))) for i in some]
            held.clear()
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "data": pa.array(data, pa.binary())})

        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                for s in shingle_sets(b.column("text")):
                    if not len(s) or (name := node_of(s)) in seen:
                        continue
                    seen.add(name)
                    p = len(s) - int(need(len(s))) + 1
                    level = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                    key = level << np.uint64(56) | s >> np.uint64(8)
                    key = np.sort(np.partition(key, p - 1)[:p])
                    held.append((key, np.full(p, name), np.full(p, len(s)), np.arange(p)))
                    size += p
                    if size >= 1 << 19:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    return _texts(docs).mapInArrow(lean(run), "bucket int, data binary")


def _admit(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Length filter and positional filter. A pair is judged in the group of the first shingle that its sets share, where
    only this one and what stands behind it can overlap; in groups of later ones it may fail, as the first has it."""
    return (DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= overlap_needed(n1, n2))


def _across(node: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (2 x m) of a group's members, sorted by n, that pass the filters."""
    for i in range(len(node) - 1):
        stop = np.searchsorted(n, n[i] * DEN // NUM, "right")
        j = np.arange(i + 1, stop)
        j = j[_admit(n[i], pos[i], n[j], pos[j]) & (node[j] != node[i])]
        if len(j):
            yield np.stack([np.full(len(j), node[i]), node[j]])


PAIRS = "kind int, a long, b long, n long, pos long"


def _stars(node: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The leaders (places) of a group's members, sorted by n, and the pairs (2 x m) of each with members of like size."""
    lo, hi = 0, len(node)
    while lo < hi:
        stop = min(hi, lo + np.searchsorted(n[lo:hi], n[lo] * DEN // NUM, "right"))
        j = np.arange(lo + 1, stop)
        j = j[_admit(n[lo], pos[lo], n[j], pos[j])]
        yield lo, np.stack([np.full(len(j), node[lo]), node[j]])
        lo = stop


def group_pairs(packed: DataFrame) -> DataFrame:
    """kind 0: a pair (a, b); a comes first by n, then by node. kind 1: a member of a large group (a: shingle, b: node, n,
    pos). kind 2: the same, of a leader in a group that is dealt over several buckets."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, pos: np.ndarray | None = None) -> pa.RecordBatch:
        zero = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), zero if n is None else pa.array(n), zero if pos is None else pa.array(pos)], ["kind", "a", "b", "n", "pos"])

    def one(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, node, n, pos = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
        order = np.lexsort((node, n, key))
        key, node, n, pos = key[order], node[order], n[order], pos[order]
        fresh = np.ones(len(key), bool)  # a node that several tasks met counts once
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, pos = key[fresh], node[fresh], n[fresh], pos[fresh]
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(cuts)
        dealt = 2.0 ** ((key[cuts[:-1]] >> np.uint64(56)).astype(np.float64) / 4) > HOT  # this may be a part of the group
        pairs: list[np.ndarray] = []
        two = cuts[:-1][(sizes == 2) & ~dealt]  # the common case, all at once
        if len(two):
            ok = _admit(n[two], pos[two], n[two + 1], pos[two + 1])
            pairs.append(np.stack([node[two[ok]], node[two[ok] + 1]]))
        keep, leaders = [], []
        for g in np.flatnonzero((sizes > 2) | dealt):
            lo, hi = cuts[g], cuts[g + 1]
            if hi - lo <= SMALL_GROUP and not dealt[g]:
                pairs += _across(node[lo:hi], n[lo:hi], pos[lo:hi])
                continue
            keep.append(np.arange(lo, hi))
            for at, p in _stars(node[lo:hi], n[lo:hi], pos[lo:hi]):
                pairs.append(p)
                if dealt[g]:
                    leaders.append(lo + at)
        if pairs and sum(x.shape[1] for x in pairs):
            p = np.unique(np.concatenate(pairs, axis=1), axis=1)
            yield rows(0, p[0], p[1])
        for kind, places in ((1, keep), (2, [leaders] if leaders else [])):
            if places:
                i = np.concatenate(places)
                yield rows(kind, key[i].astype(np.int64), node[i], n[i], pos[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for b in batches:
            for i, raw in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
                if i != bucket and blobs:
                    yield from one(blobs)
                    blobs = []
                bucket = i
                blobs.append(raw)
        if blobs:
            yield from one(blobs)

    return packed.repartition(fan_out(packed), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), PAIRS)


def leader_pairs(leaders: DataFrame) -> DataFrame:
    """Pairs of the leaders (a: shingle, b: node, n, pos) of groups that were dealt over several buckets: few for each
    bucket, and streamed in order, so that a task holds the leader at hand only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = None
        for b in batches:
            left, right = [], []
            for k, node, n, pos in zip(*(b.column(c).to_pylist() for c in ("a", "b", "n", "pos")), strict=True):
                if k != key or n * NUM > head[1] * DEN:
                    key, head = k, (node, n, pos)
                elif node != head[0] and _admit(np.int64(head[1]), np.int64(head[2]), np.int64(n), np.int64(pos)):
                    left.append(head[0])
                    right.append(node)
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return leaders.repartition(fan_out(leaders), "a").sortWithinPartitions("a", "n", "b").mapInArrow(lean(run), "a long, b long")


def fine_counts(texts: DataFrame) -> DataFrame:
    """node, fine: each set's shingles counted in FINE hash ranges, packed; counts stop at 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = shingle_sets(pa.array([zlib.decompress(x) for x in part.column("text").to_pylist()], pa.large_binary()))
                bins = [np.minimum(np.bincount((s >> np.uint64(64 - FINE_BITS)).astype(np.int64), minlength=FINE), 255).astype(np.uint8) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([zlib.compress(x.tobytes(), 1) for x in bins], pa.binary())], ["node", "fine"])

    return texts.mapInArrow(lean(run), "node long, fine binary")


def _close(n: np.ndarray, pos: np.ndarray, label: np.ndarray, block: np.ndarray, bins: np.ndarray, spanning: bool) -> Iterator[np.ndarray]:
    """Pairs (2 x m, places) of a group's members, sorted by n, that pass all filters, the suffix filter in fine ranges
    included, and have different labels; only pairs of the two blocks where there are two. Spanning: pairs that likely
    link, and of these only what joins labels not yet joined by pairs before, at most one pair a label."""
    label, full, two = label.copy(), (bins == 255).any(axis=1), block.min() != block.max()
    for i in range(len(n) - 1):
        stop = np.searchsorted(n, n[i] * DEN // NUM, "right")
        j = np.arange(i + 1, stop)
        j = j[(label[j] != label[i]) & _admit(n[i], pos[i], n[j], pos[j])]
        if two:
            j = j[block[j] != block[i]]
        if not len(j):
            continue
        bound = np.minimum(bins[j], bins[i]).sum(axis=1, dtype=np.int64)
        margin = bound - overlap_needed(n[i], n[j])
        if spanning:
            # chance matches of what the sets do not share raise the bound; the pairs left out here come in the end
            margin = margin - ((n[i] - bound) * (n[j] - bound) // FINE + 1)
            j, margin = j[margin >= 0], margin[margin >= 0]
            best = np.argsort(-margin, kind="stable")
            _, first = np.unique(label[j[best]], return_index=True)
            j = j[best[first]]
            label[np.isin(label, label[j])] = label[i]
        else:
            j = j[(margin >= 0) | full[j] | full[i]]
        if len(j):
            yield np.stack([np.full(len(j), i), j])


def dealt_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, n, pos, label, block, x, y: the members of large groups that still hold several classes, once for each pair
    of blocks (x, y) in which they can meet another class. A class of BLOCK / 2 members or more has blocks of its own."""
    labelled = members.join(labels.select(F.col("node").alias("b"), F.col("component").alias("label")), "b", "left").withColumn("label", F.coalesce("label", "b"))
    sizes = labelled.groupBy("a", "label").agg(F.count("*").alias("c"))
    large = F.col("c") >= F.lit(BLOCK // 2)
    per = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.sort_array(F.collect_list(F.when(large, F.struct("label", per.alias("k")))))  # at most 2 / BLOCK of the members
    groups = sizes.groupBy("a").agg(F.count("*").alias("classes"), own.alias("large"), F.coalesce(F.ceil(F.sum(F.when(~large, F.col("c"))) / BLOCK), F.lit(0)).cast("int").alias("rest"))
    groups = cut(groups.where("classes > 1").select("a", "large", "rest", F.aggregate("large", F.lit(0), lambda t, x: t + x["k"]).alias("own")))
    # sent to all tasks while they are few, so that a group's members stay where they are; else Spark splits large groups
    n = groups.agg(F.count("*") + F.coalesce(F.sum(F.size("large")), F.lit(0))).first()[0]
    sent = F.broadcast if n <= FEW_GROUPS else lambda df: df
    # blocks 0 .. rest - 1 are those of small classes; a large class has the k blocks from `at` on
    starts = groups.select("a", "large", F.posexplode("large").alias("i", "e"), "rest").select("a", F.col("e.label").alias("label"), F.col("e.k").alias("k"), F.expr("rest + aggregate(slice(large, 1, i), 0, (t, x) -> t + x.k)").alias("at"))
    left = labelled.join(sent(groups.select("a", "rest", "own")), "a").join(sent(starts), ["a", "label"], "left")
    spot = F.xxhash64("b")
    left = left.withColumn("block", F.when(F.col("k").isNotNull(), F.col("at") + F.pmod(spot, F.col("k"))).otherwise(F.pmod(spot, F.greatest(F.col("rest"), F.lit(1)))).cast("int"))
    others = F.sequence(F.lit(0), F.col("rest") + F.col("own") - 1)
    others = F.when(F.col("k").isNull(), others).otherwise(F.filter(others, lambda o: (o < F.col("at")) | (o >= F.col("at") + F.col("k"))))
    left = left.select("a", "b", "n", "pos", "label", "block", F.explode(others).alias("other"))
    return left.select("a", "b", "n", "pos", "label", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def cross_pairs(members: DataFrame, labels: DataFrame, fine: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (a, b; a first by n, then by node) of members of one large group whose classes still differ. members: a
    (shingle), b (node), n, pos. No task holds more than two blocks of a group."""
    left = dealt_blocks(members, labels).join(fine.withColumnRenamed("node", "b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def one() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            node, n, pos, label, block = (t.column(c).to_numpy() for c in ("b", "n", "pos", "label", "block"))
            bins = np.frombuffer(b"".join(zlib.decompress(x) for x in t.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
            found, size = [], 0
            for p in _close(n, pos, label, block, bins, spanning):
                found.append(p)
                size += p.shape[1]
                if size > 1 << 18:
                    yield out(node, found)
                    found, size = [], 0
            if found:
                yield out(node, found)

        def out(node: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
            p = node[np.concatenate(found, axis=1)]
            return pa.RecordBatch.from_pydict({"a": pa.array(p[0]), "b": pa.array(p[1])})

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("a", "x", "y")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *edges], [*edges, b.num_rows], strict=True):
                now = tuple(keys[:, start])
                if held and now != key:
                    yield from one()
                key = now
                held.append(b.slice(start, stop - start))
        if held:
            yield from one()

    return left.repartition(fan_out(members), "a", "x", "y").sortWithinPartitions("a", "x", "y", "n", "b").mapInArrow(lean(run), "a long, b long").distinct()


def suffix_filter(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose shingles, counted by hash range, still allow the overlap. nodes: node, n, data (packed bins)."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("data").alias(f"d{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(map(zlib.decompress, b.column(c).to_pylist())), np.uint16).reshape(-1, BINS) for c in ("da", "db"))
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            ok = np.minimum(x, y).sum(axis=1, dtype=np.int64) >= overlap_needed(na, nb)
            # counts over 65535 wrap; such sets are left to the verification
            ok |= np.maximum(na, nb) > 65535
            yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(ok))

    return both.mapInArrow(lean(run), "a long, b long")


def _filter_bits(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds all the nodes (and by chance some others)."""
    spot = F.pmod(F.col("node"), F.lit(1 << FILTER_BITS))
    rows = nodes.groupBy(F.bitmap_bucket_number(spot + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot + 1)).alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows:  # at most 2^FILTER_BITS / 32768 rows of 4 KB
        at = (r["k"] - 1) * 4096
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[at : at + len(bits)] |= bits
    return np.unpackbits(out, bitorder="little").astype(bool)


def node_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text (packed) of the wanted nodes, one text each."""
    bits = _filter_bits(wanted)
    packed_bits = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        have = np.unpackbits(packed_bits).astype(bool)
        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                node, rows = [], []
                for i, s in enumerate(shingle_sets(b.column("text"))):
                    if len(s) and have[(name := node_of(s)) % (1 << FILTER_BITS)] and name not in seen:
                        seen.add(name)
                        node.append(name)
                        rows.append(i)
                texts = b.column("text").take(pa.array(rows, pa.int64())).to_pylist()
                yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "text": pa.array([zlib.compress(t.encode("utf-8", "surrogatepass"), 6) for t in texts], pa.binary())})

    return _texts(docs).mapInArrow(lean(run), "node long, text binary").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. a's texts go to as many tasks as its pairs need."""
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("k"))
    placed = pairs.join(per, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))
    hubs = per.join(texts, per["a"] == texts["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    spokes = placed.join(texts, placed["b"] == texts["node"]).select("a", "salt", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for b in batches:
            a, other, raw = b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text").to_pylist()
            left, right = [], []
            for lo in range(0, len(a), 256):
                part = slice(lo, lo + 256)
                sets = shingle_sets(pa.array([zlib.decompress(x) for x in raw[part]], pa.large_binary()))
                for x, y, s in zip(a[part], other[part], sets, strict=True):
                    if y is None:
                        hub, own = x, s
                    elif hub == x:
                        small, big = (own, s) if len(own) < len(s) else (s, own)
                        at = np.searchsorted(big, small)
                        at[at == len(big)] = 0
                        if int((big[at] == small).sum()) >= int(overlap_needed(len(own), len(s))):
                            left.append(x)
                            right.append(y)
                    else:
                        raise AssertionError("a pair without its first text")
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    both = hubs.unionByName(spokes).repartition(fan_out(pairs), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.mapInArrow(lean(run), "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    described = cut(describe(docs))
    levels = frequency_levels(described)
    rows = described.where("part < 0").select("doc_id", "n", "node", "data")
    nodes = cut(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("data").alias("data")))
    grouped = cut(group_pairs(prefixes(docs, levels, 4 * fan_out(docs))))

    pairs = grouped.where("kind = 0").select("a", "b").unionByName(leader_pairs(grouped.where("kind = 2").select("a", "b", "n", "pos")))
    near = cut(suffix_filter(pairs.distinct(), nodes))
    members = grouped.where("kind = 1").select("a", "b", "n", "pos")
    inside = members.select(F.col("b").alias("node")).distinct()
    wanted = cut(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).unionByName(inside).distinct())
    texts = cut(node_texts(docs, wanted))
    links = cut(verify(near, texts))
    found = cut(components(links))
    fine = cut(fine_counts(texts.join(inside, "node", "left_semi")))
    # first what joins the most classes with the fewest pairs, then all pairs across classes that are left
    seen = near
    for spanning in (True, False):
        more = cut(cross_pairs(members, found, fine, spanning).join(seen, ["a", "b"], "left_anti"))
        new = None if more.isEmpty() else cut(verify(more, texts))
        seen = seen.unionByName(more)
        if new is not None and not new.isEmpty():
            links = links.unionByName(new)
            found = cut(components(links))
    # classes by their smallest document
    full = nodes.select("node", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = full.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = full.join(first, "component").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
