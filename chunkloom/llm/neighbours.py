"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver on at most SAMPLE vectors, those of smallest hash; every vector goes to the leaf that
it descends to. A query opens nodes from a priority queue by the inner product with their centres until it has visited
as many leaves as reach TARGET_RECALL on CALIBRATION queries, whose true neighbours are found among all rows.

Equal vectors are one point with the smallest ids that can show up in a result, so a vector that fills a third of the
table costs as much as any other; nothing is lost, as ties go to smaller ids. Neighbouring leaves are one group, of up
to GROUP_BYTES of vectors; a leaf of more falls into several groups. A query goes to each group once, and a task keeps
the points of one group and streams the queries past them.

Defined results: vectors that are null, zero, not finite in some component or null in one, or not of the table's most
frequent length take no part (neither as queries nor as candidates); a query with fewer candidates than k gets them
all; rows that share a vec_id are one query, which gets the nearest of all their vectors, no candidates of each other,
and candidates of others once for each row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.common import cut, fan_out, lean
from chunkloom.llm.packed import column_bytes

SAMPLE, BRANCHES, LEAF_POINTS, MAX_LEAVES = 20_000, 8, 256, 4096
CALIBRATION, TARGET_RECALL, SEED = 128, 0.95, 5
#: Vectors of a group of leaves; queries that a task compares with them at a time, and scores that it holds.
GROUP_BYTES, QUERIES, SCORES = 96 << 20, 512, 1 << 20


@dataclass
class Node:
    centres: np.ndarray  # of the children
    children: list[int] = field(default_factory=list)  # node number, or -1 - leaf


class Tree:
    def __init__(self, sample: np.ndarray, leaves: int, seed: int = SEED) -> None:
        """leaves: about how many leaves to make; never more than one for each two sample points."""
        self.nodes: list[Node] = []
        self.leaves = 0
        self._r = np.random.default_rng(seed)
        size = max(2, -(-len(sample) // max(1, leaves)))
        self.root = self._grow(sample, size)

    def _grow(self, x: np.ndarray, size: int) -> int:
        if len(x) <= size:
            self.leaves += 1
            return -self.leaves
        centres, own = self._kmeans(x, min(BRANCHES, -(-len(x) // size)))
        if len(centres) < 2:
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append(Node(centres))
        self.nodes[at].children = [self._grow(x[own == i], size) for i in range(len(centres))]
        return at

    def _kmeans(self, x: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        c = x[self._r.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            own = self._nearest(x, c)
            c = np.stack([x[own == i].mean(axis=0) for i in range(len(c)) if (own == i).any()])
        c = np.unique(c, axis=0)
        own = self._nearest(x, c)
        used = np.unique(own)
        return c[used], np.searchsorted(used, own)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.empty(len(x), np.int32)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            if at < 0:
                out[rows] = -1 - at
                continue
            own = self._nearest(x[rows], self.nodes[at].centres)
            stack += [(child, rows[own == i]) for i, child in enumerate(self.nodes[at].children) if (own == i).any()]
        return out

    def bins(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query (row) and leaf the smallest inner product on the leaf's path, and the leaf's own. Best bin first
        comes to leaves in the order of the first; among those with the same, the second decides."""
        least, own = (np.empty((len(q), self.leaves)) for _ in range(2))
        stack = [(self.root, np.full(len(q), np.inf), np.full(len(q), np.inf))]
        while stack:
            at, low, last = stack.pop()
            if at < 0:
                least[:, -1 - at], own[:, -1 - at] = low, last
                continue
            s = q @ self.nodes[at].centres.T
            stack += [(child, np.minimum(low, s[:, i]), s[:, i]) for i, child in enumerate(self.nodes[at].children)]
        return least, own

    def order(self, q: np.ndarray) -> np.ndarray:
        """The leaves in the order of a best-bin-first traversal."""
        least, own = self.bins(q)
        return np.lexsort((-own, -least), axis=1)

    def visited(self, q: np.ndarray, most: int) -> np.ndarray:
        """Whether each leaf (column) is among the first `most` of each query (row)."""
        if most >= self.leaves:
            return np.ones((len(q), self.leaves), bool)
        least, own = self.bins(q)
        last = np.partition(least, self.leaves - most, axis=1)[:, self.leaves - most, None]
        out = least >= last
        for i in np.flatnonzero(out.sum(axis=1) > most):
            tie = np.flatnonzero(least[i] == last[i])
            out[i, tie[np.argsort(-own[i, tie], kind="stable")[most - int(out[i].sum()) :]]] = False
        return out


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """The vectors of a binary column, as they are stored."""
    raw, offsets = column_bytes(column)
    return raw.view(kind).reshape(len(column), -1) if len(raw) else np.empty((len(column), 0), kind)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = df[vec_col].cast("array<double>")
    ok = df.select(df[id_col].cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    ok = ok.withColumn("n", F.size("v"))
    length = ok.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).select(F.col("n").alias("_n"))
    return ok.join(F.broadcast(length), F.col("n") == F.col("_n")).select("vec_id", "v")  # one row


def _to_bytes(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("v").flatten()).astype(kind).reshape(b.num_rows, -1) + np.array(0, kind)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "v": pa.array([r.tobytes() for r in x], pa.binary())})

    return run


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target_recall: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`."""
    kind = "<f4" if df.schema[vec_col].dataType == T.ArrayType(T.FloatType(), df.schema[vec_col].dataType.containsNull) else "<f8"  # bytes kept; all products are double
    rows = usable(df, id_col, vec_col).mapInArrow(lean(_to_bytes(kind)), "vec_id long, v binary")
    first = Window.partitionBy("v").orderBy("vec_id")
    # the k + 1 smallest ids of each distinct vector; Spark limits each group before the shuffle
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    points = cut(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("pid"), "v", "ids"))
    if points.count() > points.select("pid").distinct().count():
        # ids with several vectors: points get numbers of their own, in the order of their smallest ids
        ordered = points.repartitionByRange(fan_out(df), "pid", "v").sortWithinPartitions("pid", "v")
        points = cut(ordered.select(F.monotonically_increasing_id().alias("pid"), "v", "ids"))
    asked = cut(rows.where(F.col("vec_id") % every == 0).join(points.select("v", "pid"), "v").select("vec_id", "pid"))

    n = points.count()
    sample = points.orderBy(F.xxhash64("pid"), "pid").limit(SAMPLE).select("pid", "v").collect()
    if not sample:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.frombuffer(b"".join(bytes(r["v"]) for r in sample), kind).reshape(len(sample), -1).astype(np.float64)
    width = x.shape[1] * np.dtype(kind).itemsize
    tree = Tree(x, min(MAX_LEAVES, -(-n // LEAF_POINTS)))
    visits = _calibrate(points, asked, tree, k, target_recall, kind)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(tree.leaves, np.int64)
        for b in batches:
            count += np.bincount(_assigned(tree, b.column("v"), kind), minlength=tree.leaves)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"leaf": pa.array(some, pa.int32()), "n": pa.array(count[some], pa.int64())})

    counts = np.zeros(tree.leaves, np.int64)
    for r in points.select("v").mapInArrow(lean(leaves), "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # at most MAX_LEAVES rows
        counts[r["leaf"]] = r["n"]
    # a group for each task that can run at a time, and more where these would be too large
    most = max(1, min(GROUP_BYTES // width, -(-n // (2 * df.sparkSession.sparkContext.defaultParallelism))))
    first, parts = _groups(counts, most)
    groups = int((first + parts).max())

    some = np.flatnonzero(counts)
    low, high = np.full(groups, tree.leaves), np.zeros(groups, np.int64)  # leaves of each group
    for i in range(int(parts.max())):
        at = some[parts[some] > i]
        np.minimum.at(low, first[at] + i, at)
        np.maximum.at(high, first[at] + i, at + 1)

    def tag_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, pid = _assigned(tree, b.column("v"), kind), b.column("pid").to_numpy()
            part = (pid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[leaf]
            yield pa.RecordBatch.from_pydict({"grp": pa.array(first[leaf] + part, pa.int32()), "leaf": pa.array(leaf, pa.int32()), "pid": b.column("pid"), "v": b.column("v"), "visit": pa.nulls(len(leaf), pa.binary())})

    def tag_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, QUERIES):
                b = whole.slice(lo, QUERIES)
                seen = tree.visited(_matrix(b.column("v"), kind).astype(np.float64), visits)
                for g in np.flatnonzero(low < high):
                    mine = seen[:, low[g] : high[g]]
                    at = np.flatnonzero(mine.any(axis=1))
                    bits = np.packbits(mine[at], axis=1)
                    rows, n = pa.array(at), len(at)
                    yield pa.RecordBatch.from_pydict({"grp": pa.array(np.full(n, g), pa.int32()), "leaf": pa.array(np.full(n, tree.leaves), pa.int32()), "pid": b.column("pid").take(rows), "v": b.column("v").take(rows), "visit": pa.array([x.tobytes() for x in bits], pa.binary())})

    shape = "grp int, leaf int, pid long, v binary, visit binary"
    sought = points.join(asked.select("pid").distinct(), "pid", "left_semi").select("pid", "v")
    both = points.select("pid", "v").mapInArrow(lean(tag_points), shape).unionByName(sought.mapInArrow(lean(tag_queries), shape))
    both = both.repartition(4 * max(3, groups), "grp").sortWithinPartitions("grp", "leaf")  # queries come behind all leaves

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, {}
        for whole in batches:
            if not whole.num_rows:
                continue
            grp, leaf = whole.column("grp").to_numpy(), whole.column("leaf").to_numpy()
            edges = np.flatnonzero(np.diff(grp) | np.diff(leaf)) + 1
            for start, stop in zip([0, *edges], [*edges, len(leaf)], strict=True):
                if group != grp[start]:
                    group, own = grp[start], {}
                part = whole.slice(start, stop - start)
                m, pid = _matrix(part.column("v"), kind), part.column("pid").to_numpy()
                if leaf[start] < tree.leaves:
                    own.setdefault(int(leaf[start]), []).append((m.copy(), pid.copy()))
                    continue
                for at, x in own.items():
                    if isinstance(x, list):
                        own[at] = tuple(np.concatenate(y) for y in zip(*x, strict=True))
                bits = np.unpackbits(_matrix(part.column("visit"), "u1"), axis=1)[:, np.array(list(own), np.int64) - low[group]]
                for lo in range(0, len(m) if own else 0, QUERIES):
                    at = slice(lo, lo + QUERIES)
                    yield _nearest_of(own, m[at].astype(np.float64), pid[at], bits[at].astype(bool), k + 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last query so far

        def best(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            found = column_bytes(t.column("found").combine_chunks())
            pair = found[0].view(FOUND)
            q = np.repeat(t.column("q").to_numpy(), np.diff(found[1]) // FOUND.itemsize)
            row = _best(q, pair["score"], pair["pid"], k + 1)
            return pa.RecordBatch.from_pydict({"q": pa.array(q[row], pa.int64()), "pid": pa.array(pair["pid"][row], pa.int64()), "score": pa.array(pair["score"][row], pa.float64())})

        for b in batches:
            if not b.num_rows:
                continue
            q = b.column("q").to_numpy()
            last = int(np.searchsorted(q, q[-1]))
            if last or held and held[0].column("q")[0].as_py() != q[-1]:
                yield best([*held, b.slice(0, last)])
                held = []
            held.append(b.slice(last))
        if held:
            yield best(held)

    near = both.mapInArrow(lean(compare), "q long, found binary").repartition(fan_out(df), "q").sortWithinPartitions("q").mapInArrow(lean(merge), "q long, pid long, score double")
    found = near.join(points.select("pid", "ids"), "pid").select("q", "score", F.explode("ids").alias("id"))
    mine = asked.join(found, asked["pid"] == found["q"]).where("id <> vec_id")
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "id")
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("vec_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


#: A point found and its score.
FOUND = np.dtype([("pid", "<i8"), ("score", "<f8")])


def _assigned(tree: Tree, column: pa.Array, kind: str) -> np.ndarray:
    return tree.assign(_matrix(column, kind).astype(np.float64)) if len(column) else np.empty(0, np.int32)


def _groups(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each leaf, and over how many its points are dealt: neighbours share a group while it holds `most`
    points at most."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group = held = 0
    for leaf, n in enumerate(counts.tolist()):
        if held and held + n > most:
            group, held = group + 1, 0
        first[leaf], parts[leaf] = group, max(1, -(-n // most))
        held += n
        if parts[leaf] > 1:
            group, held = group + int(parts[leaf]), 0
    return first, parts


def _best(q: np.ndarray, score: np.ndarray, pid: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's best, in order."""
    order = np.lexsort((pid, -score, q))
    if not len(order):
        return order
    sorted_ = q[order]
    begin = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    return order[np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < most]


def _nearest_of(own: dict[int, tuple[np.ndarray, np.ndarray]], m: np.ndarray, pid: np.ndarray, visits: np.ndarray, most: int) -> pa.RecordBatch:
    """The `most` nearest of a group's points (leaf: vectors, ids) for each query, of the leaves (columns) that it visits."""
    bar = np.full(len(m), -np.inf)  # at least `most` of the points so far reach it
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, s, p = (np.concatenate(x) for x in zip(*held, strict=True))
        row = _best(q, s, p, most)
        q, s, p = q[row], s[row], p[row]
        last = np.flatnonzero(np.append(q[1:] != q[:-1], True))
        full = np.bincount(q, minlength=len(m))[q[last]] == most
        bar[q[last[full]]] = s[last[full]]
        return q, s, p

    for (vectors, ids), visit in zip(own.values(), visits.T, strict=True):
        rows = np.flatnonzero(visit)
        step = max(1, SCORES // max(1, len(rows)))
        for lo in range(0, len(ids) if len(rows) else 0, step):
            s = m[rows] @ vectors[lo : lo + step].astype(np.float64).T
            open_ = np.flatnonzero(np.isneginf(bar[rows]))
            if len(open_) and s.shape[1] >= most:
                bar[rows[open_]] = np.partition(s[open_], s.shape[1] - most, axis=1)[:, s.shape[1] - most]
            i, j = np.nonzero(s >= bar[rows][:, None])  # all that tie with the last one stay, so that ids decide later
            held.append((rows[i], s[i, j], ids[lo + j]))
            size += len(i)
            if size > 4 * most * len(m):
                held = [reduced()]
                size = len(held[0][0])
    if not held:
        return pa.RecordBatch.from_pydict({"q": pa.array([], pa.int64()), "found": pa.array([], pa.binary())})
    q, s, p = reduced()
    pair = np.empty(len(q), FOUND)
    pair["pid"], pair["score"] = p, s
    begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
    cuts = [*begin.tolist(), len(q)]
    return pa.RecordBatch.from_pydict({"q": pa.array(pid[q[begin]], pa.int64()), "found": pa.array([pair[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})


def _calibrate(points: DataFrame, asked: DataFrame, tree: Tree, k: int, target: float, kind: str) -> int:
    """Leaves to visit: the fewest that hold `target` of the true neighbours of up to CALIBRATION queries. Queries are
    drawn as rows, so a vector that many of them have counts as often."""
    ids = [r["pid"] for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()]
    if not ids:
        return tree.leaves
    some = {r["pid"]: np.frombuffer(bytes(r["v"]), kind).astype(np.float64) for r in points.where(F.col("pid").isin(sorted(set(ids)))).select("pid", "v").collect()}
    names = sorted(some)
    weight = [ids.count(i) for i in names]
    q = np.stack([some[i] for i in names])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), kind).astype(np.float64)
            s, leaf = q @ x.T, tree.assign(x)
            keep = min(k, s.shape[1])
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(np.arange(len(q)), keep), pa.int32()), "leaf": pa.array(leaf[top].ravel(), pa.int32()), "score": pa.array(np.take_along_axis(s, top, axis=1).ravel(), pa.float64())})

    w = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
    true = points.select("v").mapInArrow(lean(brute), "q int, leaf int, score double").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).collect()
    order = [{leaf: i for i, leaf in enumerate(row)} for row in tree.order(q).tolist()]
    need = sorted(order[r["q"]][r["leaf"]] + 1 for r in true for _ in range(weight[r["q"]]))
    return need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]
