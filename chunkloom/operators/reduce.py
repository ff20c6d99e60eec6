"""Reduction methods: for each unique chunk, a base to encode it against, or none.

Order-free methods are joins: their index holds every earlier chunk, whatever was decided about it. The others depend
on earlier decisions, but only among chunks that share a super-feature; each such component is replayed in order of
chunk_id, and components run in parallel. Chunks without any sampled position share one super-feature and are one such
component. Where every hit is taken, no replay needs payloads, and the deltas are sized in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.operators import codec, index, smallest
from chunkloom.operators.components import components, cut
from chunkloom.operators.dedup import PLACE

DECISIONS = "chunk_id long, kind string, base_id long, chunk_size long, save_size long, depth int"


# ---- order-free methods


def by_candidates(unique: DataFrame, candidates: DataFrame) -> DataFrame:
    """The smallest delta over the candidates (ties: the smaller base_id) if it is no larger than the chunk, else a base.

    unique: chunk_id, chunk_size, payload. Payloads join the candidates late; only pairs reach the codec."""
    base = unique.select(F.col("chunk_id").alias("base_id"), F.col("payload").alias("base"))
    pairs = candidates.select("chunk_id", "base_id").join(base, "base_id").join(unique.select("chunk_id", "payload"), "chunk_id")
    return _by_best(unique, pairs.select("chunk_id", "base_id", codec.delta_sizes("payload", "base").alias("d")))


def _by_best(unique: DataFrame, sized: DataFrame) -> DataFrame:
    """The same, of sized candidates (chunk_id, base_id, d). No payload moves."""
    best = sized.groupBy("chunk_id").agg(F.min(F.struct("d", "base_id")).alias("m"))
    lz4 = F.col("lz4") if "lz4" in unique.columns else codec.lz4_sizes("payload").alias("lz4")
    d = unique.select("chunk_id", "chunk_size", lz4).join(best, "chunk_id", "left")
    ok = F.coalesce((F.col("m.d") > 0) & (F.col("m.d") <= F.col("chunk_size")), F.lit(False))
    return d.select(
        "chunk_id", F.when(ok, "DELTA").when(F.col("lz4") < F.col("chunk_size"), "BASE_LZ4").otherwise("BASE_RAW").alias("kind"),
        F.when(ok, F.col("m.base_id")).alias("base_id"), F.col("chunk_size").cast("long").alias("chunk_size"), F.when(ok, F.col("m.d")).otherwise(F.col("lz4")).cast("long").alias("save_size"),
    )


#: Bytes of bases in a slab, and of a group for each deal of its targets, and most deals.
SLAB, DEAL, DEALS = 32 << 20, 8 << 20, 4
#: Most bits of the table that says which chunks are in no group.
MEMBER_BITS = 25


def _members_only(payloads: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """payloads without most of the rows that no member (on) has, so that they need not move; an inner join does the rest."""
    bits = min(MEMBER_BITS, max(10, members.count().bit_length() + 4))
    hashed = F.shiftrightunsigned(F.xxhash64(*[F.col(x).cast("long") for x in on]), 64 - bits).alias("h")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.zeros(1 << bits, bool)
        for b in batches:
            some[b.column("h").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(some).tobytes()], pa.binary())], ["some"])

    table = np.zeros(1 << bits - 3, np.uint8)
    for r in members.select(hashed).mapInArrow(marked, "some binary").toLocalIterator():
        table |= np.frombuffer(r["some"], np.uint8)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy()
            yield b.filter(pa.array((table[h >> 3] >> (7 - (h & 7)).astype(np.uint8) & 1).astype(bool)))

    rows = payloads.select(*on, "payload", hashed)
    return rows.mapInArrow(kept, rows.schema).drop("h")


def by_all(unique: DataFrame, sf: DataFrame, payloads: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """by_candidates(unique, index.all_matches(sf)), but pairs of chunks are no rows: their number grows with the square of
    the chunks of a value. A value's chunks are bases in slabs of ids, and each slab meets the targets of its own and the
    later slabs, dealt over a few cells. So a chunk moves once for each deal and for each slab up to its own.

    unique without payloads needs lz4 (the stored size of each as a base), and payloads elsewhere, with keys `on`."""
    if payloads is None:
        payloads, on = unique.select("chunk_id", "payload"), ["chunk_id"]
    rows = cut(index.groups(sf).join(unique.select(*dict.fromkeys(["chunk_id", "chunk_size", *on])), "chunk_id").withColumn("part", F.expr("chunk_id div 4096")))
    parts = rows.groupBy("sf", "part").agg(F.sum("chunk_size").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("sf").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("bytes").over(Window.partitionBy("sf"))
    parts = parts.select("sf", "part", F.floor(before / SLAB).cast("int").alias("last"), F.least(F.lit(DEALS), 1 + F.floor(whole / DEAL)).cast("int").alias("deals"))
    placed = rows.join(parts, ["sf", "part"]).select(*dict.fromkeys(["sf", "chunk_id", "target", "last", "deals", *on]))
    rows = placed.join(_members_only(payloads, rows.select(*on), on), on)
    as_bases = F.transform(F.sequence(F.lit(0), F.col("deals") - 1), lambda i: F.struct(F.col("last").alias("slab"), i.alias("deal"), F.lit(False).alias("target")))
    deal = F.pmod("chunk_id", "deals").cast("int")
    as_targets = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.struct(i.alias("slab"), deal.alias("deal"), F.lit(True).alias("target")))
    cells = rows.select("sf", "chunk_id", "payload", F.explode(F.when(F.col("target"), F.concat(as_bases, as_targets)).otherwise(as_bases)).alias("c")).select("sf", "c.*", "chunk_id", "payload")
    n = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(n, "sf", "slab", "deal").sortWithinPartitions("sf", "slab", "deal", "target", "chunk_id")
    return _by_best(unique, cells.mapInArrow(smallest.smallest_deltas, "chunk_id long, d long, base_id long"))


def close_matches(unique: DataFrame, sf: DataFrame) -> DataFrame:
    """chunk_id, base_id: as index.all_matches, but in the one large group of chunks with zero features only the pairs that
    can hold the smallest delta: those with a block of the base in the chunk, and the first earlier chunk without one, as
    a delta against any of these is the same."""
    zero = sf.where((F.col("pos") == 0) & (F.col("sf") == F.xxhash64(*[F.lit(0).cast("long")] * 4))).select("chunk_id")
    others = index.all_matches(sf.join(zero, "chunk_id", "left_anti"))
    # numbers in the group, counted in blocks of ids and over the blocks
    zero = cut(zero.withColumn("part", F.expr("chunk_id div 4096")))
    before = zero.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("chunk_id")) - 1
    members = cut(zero.withColumn("nth", nth).join(before.select("part", "before"), "part").select("chunk_id", (F.col("nth") + F.col("before")).alias("nth")).join(unique.select("chunk_id", "payload"), "chunk_id"))
    long_enough = members.where(F.octet_length("payload") >= codec.STEP)

    def blocks(step: int) -> Column:
        return F.explode(F.array_distinct(F.expr(f"transform(sequence(1, octet_length(payload) - {codec.STEP - 1}, {step}), i -> xxhash64(substring(payload, i, {codec.STEP})))")))

    stored = long_enough.select(F.col("chunk_id").alias("base_id"), F.col("nth").alias("base_nth"), blocks(codec.STEP).alias("block"))
    near = cut(long_enough.select("chunk_id", "nth", blocks(1).alias("block")).join(stored, "block").where("base_nth < nth").select("chunk_id", "base_id", "base_nth").distinct())
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("base_nth")) - 1
    taken = near.withColumn("rank", rank).where("rank = base_nth").groupBy("chunk_id").agg(F.count("*").alias("apart"))
    apart = members.select("chunk_id", "nth").join(taken, "chunk_id", "left").withColumn("apart", F.coalesce("apart", F.lit(0))).where("apart < nth")
    apart = apart.join(members.select(F.col("chunk_id").alias("base_id"), F.col("nth").alias("apart")), "apart").select("chunk_id", "base_id")
    return others.unionByName(near.select("chunk_id", "base_id")).unionByName(apart)


# ---- replays


@dataclass(frozen=True)
class Method:
    index: str  # latest | first
    bases_only: bool
    per_position: bool = False
    choose: str = "hit"  # hit | chain_size | chain_overlap | descent | subtree | literals
    accept: str = "no_larger"  # no_larger | always | ratio (size / delta reaches the running ratio of the bases)
    rewrite: bool = False
    kind: str = "DELTA"
    keep: tuple[tuple[int, int], ...] = ()  # (tier, versions after which its entries are gone); a position is tier * 10 + number


METHODS = {
    "ntransform": Method("latest", True, True, accept="always"),
    "finesse": Method("latest", True, True, accept="always", kind="FEATURE_DELTA"),
    "odess": Method("latest", True),
    # at the end of version v entries older than v - 5 and v - 2 go; version v + 1 does not find them
    "palantir": Method("latest", True, accept="ratio", keep=((2, 6), (3, 3))),
    "bisearch": Method("latest", True, choose="locality"),
    "midf": Method("latest", False, choose="literals"),
    "mibl": Method("latest", False),
    "mibl2": Method("latest", False, choose="chain_size"),
    "mibl3": Method("latest", False, choose="chain_overlap"),
    "tree_cut": Method("first", False, choose="descent"),
    "tree_greedy": Method("first", False, choose="subtree"),
    "tree_layer": Method("first", False, choose="descent", rewrite=True),
}
METHODS["tree_cache"] = METHODS["tree_layer"]  # its cache of restored chunks changes no result
#: The ratio that a delta has to reach before there is any base, and the share of later deltas in a gain.
FIRST_RATIO, LATER = 2.0, 10.0
#: Wins in a row after which the layered tree points its index at the winner.
LAYER_WINS = 4


class Replay:
    """Decides one component's chunks, given in order."""

    def __init__(self, method: Method) -> None:
        self.m = method
        #: The last base of each member name.
        self.names: dict[str, int] = {}
        self.index: dict[tuple, int] = {}
        self.keep, self.version = dict(method.keep), 0
        self.stored: dict[tuple, int] = {}
        self.data: dict[int, bytes] = {}
        self.up: dict[int, int] = {}
        self.children: dict[int, list[int]] = {}
        self.depth: dict[int, int] = {}
        self.samples: dict[int, list[int]] = {}
        self.fits: dict[int, tuple[int, int]] = {}
        self.literals: dict[int, bytes] = {}
        #: Chunks by the blocks a delta can copy. Deltas against bases without a block of the target are all the same.
        self.holders: dict[bytes, list[int]] | None = {} if method.choose in ("chain_size", "descent", "subtree") else None
        self.near: set[int] = set()
        self.sizes: dict[int | None, int] = {}
        #: The last chain of literals: its lowest chunk, the content and the places of its blocks.
        self.grown: tuple[int, bytearray, dict[bytes, int]] | None = None

    def _key(self, pos: int, sf: int) -> tuple:
        return (pos, sf) if self.m.per_position else (sf,)

    def _aim(self, target: bytes) -> None:
        self.sizes = {}
        self.near = {c for i in range(len(target) - codec.STEP + 1) for c in self.holders.get(target[i : i + codec.STEP], ())}

    def _size(self, target: bytes, base: int | None) -> int:
        """Of the delta against base, or against any chunk without a common block (None)."""
        base = base if base in self.near else None
        if base not in self.sizes:
            self.sizes[base] = len(codec.encode(target, b"" if base is None else self.data[base]))
        return self.sizes[base]

    def _chain(self, node: int) -> list[int]:
        out = [node]
        while out[-1] in self.up:
            out.append(self.up[out[-1]])
        return out[::-1]

    def _below(self, node: int) -> Iterator[int]:
        """The chunks of the subtree without its root, level by level."""
        level = [node]
        while level:
            lower = []
            for x in level:
                for c in self.children.get(x, ()):
                    yield c
                    lower.append(c)
            level = lower

    def _apart(self, chunks: Iterable[int]) -> list[int]:
        """The first one without a common block, if there is one."""
        return next(([c] for c in chunks if c not in self.near), [])

    def _choose(self, hit: int, target: bytes, samples: list[int], sfs: list[tuple[int, int]]) -> tuple[int, bytes | bytearray, dict[bytes, int] | None]:
        m = self.m.choose
        if m == "hit":
            return hit, self.data[hit], None
        if m == "literals":
            if self.grown is None or self.grown[0] != hit:
                chain = self._chain(hit)
                self.grown = hit, bytearray(self.data[chain[0]] + b"".join(self.literals[c] for c in chain[1:])), {}
                codec.add_blocks(self.grown[2], self.grown[1])
            return self.grown
        if m == "chain_overlap":
            known = set(samples)
            best = max(self._chain(hit), key=lambda c: sum(x in known for x in self.samples[c]))
            return best, self.data[best], None
        self._aim(target)
        if m == "chain_size":
            best = min(self._chain(hit), key=lambda c: self._size(target, c))  # the first of equals, root first
            return best, self.data[best], None
        best, least = hit, self._size(target, hit)
        if m == "subtree":
            near = [(c, self._chain(c)) for c in self.near if c != hit]
            found = [(self._size(target, c), len(path), path) for c, path in near if hit in path]
            if self._size(target, None) < least:
                found += [(self._size(target, None), len(path), path) for path in map(self._chain, self._apart(self._below(hit)))]
            size, _, path = min(found, default=(least, 0, []))  # the first of equals, level by level
            return (path[-1], self.data[path[-1]], None) if size < least else (hit, self.data[hit], None)
        while True:  # descent: move to the best child while it beats the best so far
            father = best
            found = [(self._size(target, c), c) for c in self.near if self.up.get(c) == father]
            if self._size(target, None) < least:
                found += [(self._size(target, None), c) for c in self._apart(self.children.get(father, ()))]
            size, child = min(found, default=(least, father))  # the first of equals
            if size < least:
                best, least = child, size
            if best == father:
                return best, self.data[best], None
            if self.m.rewrite:
                last, wins = self.fits.get(father, (None, 0))
                wins = wins + 1 if last == best else 1
                self.fits[father] = (best, wins)
                if wins > LAYER_WINS:
                    for pos, sf in sfs:
                        if self._key(pos, sf) in self.index:
                            self.index[self._key(pos, sf)] = best
                            break

    def _insert(self, chunk: int, sfs: list[tuple[int, int]]) -> None:
        for pos, sf in sfs:
            k = self._key(pos, sf)
            if self.m.index == "latest" or k not in self.index:
                self.index[k] = chunk
                if self.keep:
                    self.stored[k] = self.version

    def _alive(self, pos: int, key: tuple) -> bool:
        return key in self.index and (pos // 10 not in self.keep or self.version - self.stored[key] <= self.keep[pos // 10])

    def again(self, chunk: int, sfs: list[tuple[int, int]], version: int) -> None:
        """A duplicate of a base stores its values anew."""
        self.version = version
        if chunk not in self.up:
            self._insert(chunk, sfs)

    def _local(self, data: bytes, name: str | None, hit: int | None, bar: float | None) -> tuple[str, int, int] | None:
        """Locality first: the last base of the same name, if its delta gains enough or features find it, too; else the base
        that features find. Kind, base and size of the delta, or None for a new base."""
        local = self.names.get(name) if self.version > 0 and name is not None else None
        if local is not None:
            size = len(codec.encode(data, self.data[local]))
            if size <= len(data) and (hit == local or bar is None or bar <= len(data) // size):
                return "LOCAL_DELTA", local, size
        if hit is not None:
            size = len(codec.encode(data, self.data[hit]))
            if size <= len(data):
                return "FEATURE_DELTA", hit, size
        return None

    def decide(self, chunk: int, data: bytes, sfs: list[tuple[int, int]], samples: list[int], version: int = 0, name: str | None = None, bar: float | None = None) -> tuple:
        """(chunk_id, kind, base_id, chunk_size, save_size, depth). bar: what a delta has to reach where the method compares
        it with the chunks before; None: there are none."""
        self.version = version
        hit = next((self.index[k] for pos, k in ((x[0], self._key(*x)) for x in sfs) if self._alive(pos, k)), None)
        base, save = None, codec.lz4_size(data)
        kind = "BASE_LZ4" if save < len(data) else "BASE_RAW"
        if self.m.choose == "locality":
            found = self._local(data, name, hit, bar)
            if found is not None:
                kind, base, save = found
                self.up[chunk] = base
            else:
                self.names[name] = chunk
        elif hit is not None:
            at, content, known = self._choose(hit, data, samples, sfs)
            runs, added = codec.delta_parts(data, content, known)
            size = len(codec.pack(runs, added))
            if self.m.accept == "always" or (size <= len(data) if self.m.accept == "no_larger" else len(data) >= (FIRST_RATIO if bar is None else bar) * size):
                base, save, kind = at, size, self.m.kind
                self.up[chunk] = at
                self.children.setdefault(at, []).append(chunk)
                if self.m.choose == "literals":
                    self.literals[chunk] = added
                    start = len(content) // codec.STEP * codec.STEP
                    content += added
                    codec.add_blocks(known, content, start)
                    self.grown = chunk, content, known
        if base is None or not self.m.bases_only:
            self._insert(chunk, sfs)
            self.data[chunk], self.samples[chunk] = data, samples
            if self.holders is not None and sfs:
                for i in range(0, len(data) - codec.STEP + 1, codec.STEP):
                    held = self.holders.setdefault(data[i : i + codec.STEP], [])
                    if not held or held[-1] != chunk:
                        held.append(chunk)
        self.depth[chunk] = 0 if base is None else self.depth[base] + 1
        return chunk, kind, base, len(data), save, self.depth[chunk]


def _grouped(sf: DataFrame, key: Column) -> DataFrame:
    """node, component of chunks that share a key with another one."""
    # the smallest chunk of each value links all chunks of it
    keyed = sf.select("chunk_id", key.alias("k"))
    lead = keyed.groupBy("k").agg(F.min("chunk_id").alias("lead"))
    return components(keyed.join(lead, "k").select(F.col("lead").alias("a"), F.col("chunk_id").alias("b")))


def always(unique: DataFrame, sf: DataFrame, how: Method) -> DataFrame:
    """replay() of a method that takes every hit and stores bases only: a value has one base for good, the first to bring
    it, and of chunks with the same values only the first can be a base. So only these are replayed, without payloads."""
    vectors = sf.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sf"))).alias("sfs"))
    first = cut(vectors.groupBy("sfs").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id", F.transform("sfs", lambda x: F.xxhash64(x["pos"], x["sf"])).alias("ks")))
    found = _grouped(first.select("chunk_id", F.explode("ks").alias("k")), F.col("k"))
    rows = first.join(found.select(F.col("node").alias("chunk_id"), "component"), "chunk_id", "left").withColumn("component", F.coalesce("component", "chunk_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, seen = None, set()
        for b in batches:
            out = []
            for c, chunk, ks in zip(*(b.column(x).to_pylist() for x in ("component", "chunk_id", "ks")), strict=True):
                if c != component:
                    component, seen = c, set()
                if seen.isdisjoint(ks):
                    out += [(k, chunk) for k in set(ks)]
                    seen.update(ks)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["k", "base_id"])

    owners = rows.select("component", "chunk_id", "ks").repartition("component").sortWithinPartitions("component", "chunk_id").mapInArrow(run, "k long, base_id long")
    hits = sf.select("chunk_id", "pos", F.xxhash64("pos", "sf").alias("k")).join(owners, "k").where("base_id < chunk_id")
    hits = hits.groupBy("chunk_id").agg(F.min(F.struct("pos", "base_id")).alias("m")).select("chunk_id", "m.base_id")
    base = unique.select(F.col("chunk_id").alias("base_id"), F.col("payload").alias("base"))
    d = unique.select("chunk_id", "payload").join(hits.join(base, "base_id"), "chunk_id", "left")
    sized = d.select("chunk_id", "base_id", F.length("payload").cast("long").alias("chunk_size"), codec.lz4_sizes("payload").alias("lz4"), codec.delta_sizes("payload", F.coalesce("base", F.lit(b""))).alias("d"))
    hit, size = F.col("base_id").isNotNull(), F.col("chunk_size")
    kind = F.when(hit, how.kind).when(F.col("lz4") < size, "BASE_LZ4").otherwise("BASE_RAW").alias("kind")
    return sized.select("chunk_id", kind, "base_id", "chunk_size", F.when(hit, F.col("d")).otherwise(F.col("lz4")).alias("save_size"), hit.cast("int").alias("depth"))


def replay(unique: DataFrame, sf: DataFrame, method: str, samples: DataFrame | None = None, repeats: DataFrame | None = None, names: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """unique: chunk_id, payload; sf: chunk_id, pos, sf (long); samples: chunk_id, s (array), for chain_overlap only.

    Methods whose entries expire need the place of chunks in unique, too, and of their duplicates in repeats; the locality
    method needs version_no in unique, and names: chunk_id, name. threshold: the whole ratio that a local delta has to reach
    there, in place of the estimate of its gain.

    Methods that compare a delta with averages over all chunks before are replayed again and again, each time with the
    averages that the last decisions give, until no decision changes. A chunk's decision depends on earlier ones only, so
    what does not change is what one pass over all chunks in order decides."""
    how = METHODS[method]
    if how.accept == "always" and how.choose == "hit" and how.bases_only and how.per_position:
        return always(unique, sf, how)
    bar = _ratio_bar if how.accept == "ratio" else _gain_bar if how.choose == "locality" else None
    keys = sf.select("chunk_id", F.xxhash64("pos", "sf").alias("k") if how.per_position else F.xxhash64("sf").alias("k"))
    if names is not None:
        keys = keys.unionByName(names.where("name is not null").select("chunk_id", F.xxhash64(F.lit("name"), "name").alias("k")))
    component = cut(_grouped(keys, F.col("k")))
    once = lambda bars: _replayed(unique, sf, how, component, samples, repeats, names, bars)
    if bar is None:
        return once(None)
    if threshold is not None:
        return once(unique.select("chunk_id", F.lit(float(threshold)).alias("bar")))
    last = None
    for _ in range(MAX_ROUNDS):
        now = cut(once(None if last is None else bar(last)))
        if last is not None and now.join(last, ["chunk_id", "kind", "base_id"], "left_anti").where("base_id is not null").isEmpty() and now.where("base_id is null").join(last.where("base_id is null"), "chunk_id", "left_anti").isEmpty():
            return now
        last = now
    raise RuntimeError("the decisions did not settle")


#: Replays until the decisions have to agree.
MAX_ROUNDS = 100


def _before(decisions: DataFrame, **sums: Column) -> DataFrame:
    """chunk_id and each sum over all chunks with a smaller id, in two levels."""
    d = decisions.select("chunk_id", F.expr("chunk_id div 65536").alias("part"), *[x.cast("double").alias(n) for n, x in sums.items()])
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = d.groupBy("part").agg(*[F.sum(n).alias(n) for n in sums]).select("part", *[F.coalesce(F.sum(n).over(upto), F.lit(0.0)).alias(f"{n}_") for n in sums])
    inner = Window.partitionBy("part").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return d.select("part", "chunk_id", *[F.coalesce(F.sum(n).over(inner), F.lit(0.0)).alias(n) for n in sums]).join(parts, "part").select("chunk_id", *[(F.col(n) + F.col(f"{n}_")).alias(n) for n in sums])


def _base_sums() -> dict[str, Column]:
    base = F.col("base_id").isNull()
    return {"raw": F.when(base, F.col("chunk_size")).otherwise(0), "small": F.when(base, F.col("save_size")).otherwise(0), "bases": base.cast("int")}


def _ratio_bar(decisions: DataFrame) -> DataFrame:
    """chunk_id, bar: raw over stored bytes of the bases before."""
    return _before(decisions, **_base_sums()).select("chunk_id", F.when(F.col("small") > 0, F.col("raw") / F.when(F.col("small") > 0, F.col("small"))).alias("bar"))


def _gain_bar(decisions: DataFrame) -> DataFrame:
    """chunk_id, bar: the same ratio, and behind it what later deltas gain: the mean whole ratio of the deltas before, times
    the whole deltas for each base before, over LATER. Null, so that all is taken, before the first delta."""
    delta = F.col("base_id").isNotNull()
    b = _before(decisions, **_base_sums(), deltas=delta.cast("int"), gains=F.when(delta, F.expr("chunk_size div save_size")).otherwise(0))
    some = (F.col("small") > 0) & (F.col("deltas") > 0)
    of = lambda x: F.when(some, F.col(x))
    return b.select("chunk_id", (of("raw") / of("small") + of("gains") / of("deltas") * F.floor(of("deltas") / of("bases")) / LATER).alias("bar"))


def _replayed(unique: DataFrame, sf: DataFrame, how: Method, found: DataFrame, samples: DataFrame | None, repeats: DataFrame | None, names: DataFrame | None, bars: DataFrame | None) -> DataFrame:
    order = PLACE if how.keep else ["chunk_id"]
    version = ["version_no"] if how.keep or how.choose == "locality" else []
    rows = unique.select(*{"chunk_id": 0, "payload": 0} | dict.fromkeys([*order, *version]))
    if repeats is not None:
        rows = rows.unionByName(repeats.select("chunk_id", *order, F.lit(None).cast("binary").alias("payload")))
    rows = rows.join(found.select(F.col("node").alias("chunk_id"), "component"), "chunk_id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "chunk_id"))
    probes = sf.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sf"))).alias("sfs"))  # a few for each chunk
    rows = rows.join(probes, "chunk_id", "left")
    rows = rows.join(samples.select("chunk_id", "s"), "chunk_id", "left") if samples is not None else rows.withColumn("s", F.lit(None).cast("array<bigint>"))

    rows = rows.join(names.select("chunk_id", "name"), "chunk_id", "left") if names is not None else rows.withColumn("name", F.lit(None).cast("string"))
    rows = rows.join(bars, "chunk_id", "left") if bars is not None else rows.withColumn("bar", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, state = None, None
        names = [x.split()[0] for x in DECISIONS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for b in batches:
            out = []
            for c, chunk, data, sfs, s, v, name, bar in zip(*(b.column(x).to_pylist() for x in ("component", "chunk_id", "payload", "sfs", "s", "version", "name", "bar")), strict=True):
                if c != component or state is None:
                    component, state = c, Replay(how)
                sfs = [(x["pos"], x["sf"]) for x in sfs or ()]
                if data is None:
                    state.again(chunk, sfs, v)
                else:
                    out.append(state.decide(chunk, data, sfs, s or [], v, name, bar))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    ordered = rows.withColumn("version", F.col("version_no") if version else F.lit(0)).repartition("component").sortWithinPartitions("component", *order)
    ordered = ordered.select("component", "chunk_id", "payload", "sfs", "s", "version", "name", "bar")
    return ordered.mapInArrow(run, DECISIONS)


__all__ = ["METHODS", "Method", "Replay", "always", "by_all", "by_candidates", "close_matches", "replay"]
