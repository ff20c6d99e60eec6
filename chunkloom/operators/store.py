"""Containers, chains, and exports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators import codec
from chunkloom.operators.components import cut as to_checkpoint
from chunkloom.operators.components import parted

CONTAINER_BYTES = 4 << 20


RUN = 1 << 20


def _jumps(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of chunks: prefix sums, and for a container that begins with each chunk how many more containers begin
    behind it within the run, and how full the last one is at its end."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    m = len(sizes)
    behind = np.maximum(np.searchsorted(total, total[:-1] + capacity, "right") - 1, np.arange(1, m + 1))  # the next container's first chunk
    more, fill = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i, j in zip(range(m - 1, -1, -1), behind[::-1].tolist(), strict=True):
        if j >= m:
            fill[i] = total[m] - total[i]
        else:
            more[i], fill[i] = more[j] + 1, fill[j]
    return total, more, fill


def pack(chunks: DataFrame, capacity: int = CONTAINER_BYTES, restart: bool = False, run: int = RUN) -> DataFrame:
    """version_no, chunk_id, container_id, container_offset, stored: next-fit packing of all chunks in order, from version
    to version; with restart, a version's last container is closed with it.

    Runs of chunk_ids are packed in parallel. Where a run's first container begins depends on how full the one before
    is, but from there on on nothing else: so each run gives a table from that to what it leaves, one pass over the
    runs' tables gives each its start, and the runs place their chunks."""
    rows = chunks.select(F.col("version_no").cast("int"), F.col("chunk_id").cast("long"), F.col("stored").cast("long"))
    rows = rows.select("*", F.floor(F.col("chunk_id") / run).cast("long").alias("part"), (F.col("version_no") if restart else F.lit(0)).cast("int").alias("line"))
    ordered = rows.repartition("line", "part").sortWithinPartitions("line", "part", "chunk_id")

    def groups(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            line, part = b.column("line").to_numpy(), b.column("part").to_numpy()
            edges = np.flatnonzero(np.diff(line) | np.diff(part)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
                now = int(line[lo]), int(part[lo])
                if held and now != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo).select(["line", "part", "stored", *more]))
        if held:
            yield key, pa.Table.from_batches(held)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (line, part), t in groups(batches, []):
            total, more, fill = _jumps(t.column("stored").to_numpy(), capacity)
            n = min(len(more), int(np.searchsorted(total, capacity, "right")))  # chunks that can be the first not to fit
            data = np.concatenate((total[:n], more[:n], fill[:n])).astype(np.int64).tobytes()
            yield pa.RecordBatch.from_pydict({"line": pa.array([line], pa.int32()), "part": pa.array([part], pa.int64()), "bytes": pa.array([int(total[-1])], pa.int64()), "data": pa.array([data], pa.binary())})

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, container, fill = None, 0, 0
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("line", "part", "bytes", "data")), strict=True):
                if row[0] != line:
                    line, container, fill = row[0], 0, 0
                out.append((line, row[1], container, fill))
                total, more, rest = np.frombuffer(row[3], np.int64).reshape(3, -1)
                if not fill:
                    container, fill = container + int(more[0]), int(rest[0])
                elif fill + row[2] <= capacity:
                    fill += row[2]
                else:  # the first chunk that does not fit begins a container
                    j = max(0, int(np.searchsorted(total, capacity - fill, "right")) - 1)
                    container, fill = container + 1 + int(more[j]), int(rest[j])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["line", "part", "container", "fill"])

    states = ordered.mapInArrow(tables, "line int, part long, bytes long, data binary").repartition("line").sortWithinPartitions("line", "part")
    starts = states.mapInArrow(stitch, "line int, part long, container long, fill long")
    placed = ordered.join(starts, ["line", "part"]).repartition("line", "part").sortWithinPartitions("line", "part", "chunk_id")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, ["version_no", "chunk_id", "container", "fill"]):
            container, fill = t.column("container")[0].as_py(), t.column("fill")[0].as_py()
            cid, off = [], []
            for n in t.column("stored").to_pylist():
                if fill and fill + n > capacity:
                    container, fill = container + 1, 0
                cid.append(container)
                off.append(fill)
                fill += n
            t = t.combine_chunks()
            yield pa.RecordBatch.from_pydict({"version_no": t.column("version_no").chunk(0), "chunk_id": t.column("chunk_id").chunk(0), "container_id": pa.array(cid, pa.int64()), "container_offset": pa.array(off, pa.int64()), "stored": t.column("stored").chunk(0)})

    return placed.mapInArrow(place, "version_no int, chunk_id long, container_id long, container_offset long, stored long")


def chains(edges: DataFrame, cut=to_checkpoint, rounds: int = 40) -> DataFrame:
    """node, root, depth of every node of edges (chunk_id, base_id), by pointer doubling: log2(depth) joins."""
    at = edges.select(F.col("chunk_id").alias("node"), F.col("base_id").alias("up"), F.lit(1).alias("depth"))
    for _ in range(rounds):
        nxt = at.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        joined = at.join(nxt, "up", "left")
        at = cut(joined.select("node", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("node", F.col("up").alias("root"), "depth")


def subtree_sizes(edges: DataFrame, cut=to_checkpoint) -> DataFrame:
    """root, nodes, deepest of each tree of edges (the root counts)."""
    return chains(edges, cut).groupBy("root").agg((F.count("*") + 1).alias("nodes"), F.max("depth").alias("deepest"))


# ---- stored chunks and their restore

STORED = "chunk_id long, kind string, base_id long, chunk_size long, stored binary"
STORED_NAMES = [x.split()[0] for x in STORED.split(", ")]
#: Trees of deltas up to so many bytes are coded in one task each; larger ones level by level, over all tasks.
TREE_BYTES = 32 << 20


def encode_stored(unique: DataFrame, decisions: DataFrame, grown: bool = False) -> DataFrame:
    """chunk_id, kind, base_id, chunk_size, stored of all chunks (unique: chunk_id, payload) as decided.

    A delta is made against its base's content. grown: against the content of the chain's root and, behind it, the bytes
    added by each delta on the way to the base, so that no delta has to be decoded for it."""
    d = unique.select("chunk_id", "payload", F.octet_length("payload").cast("long").alias("chunk_size")).join(decisions.select("chunk_id", "kind", "base_id"), "chunk_id")
    if grown:
        return _down_trees(d.select("chunk_id", "kind", "base_id", "chunk_size", F.col("payload").alias("stored")), _encode, True).select(*STORED_NAMES)
    d = d.join(unique.select(F.col("chunk_id").alias("base_id"), F.col("payload").alias("base")), "base_id", "left")
    return _level(d.select("chunk_id", "kind", "base_id", "chunk_size", F.col("payload").alias("stored"), "base"), _encode, False).select(*STORED_NAMES)


def decode_stored(stored: DataFrame, grown: bool = False) -> DataFrame:
    """chunk_id, payload of all stored chunks, each decoded once, behind its base. A chunk whose size is not that noted gets
    a null payload, as does all that builds on it."""
    return _down_trees(stored.select(*STORED_NAMES), _decode, grown).select("chunk_id", F.col("stored").alias("payload"))


def _encode(data: bytes, size: int, base: bytes | None) -> tuple[bytes, bytes, bytes]:
    """What goes into the table, the content, and the bytes added."""
    if base is None:
        return codec.lz4_pack(data), data, b""
    own = codec.encode(data, base)
    return own, data, codec.literals(own)


def _decode(stored: bytes, size: int, base: bytes | None) -> tuple[bytes | None, bytes | None, bytes]:
    if base is None:
        data = codec.lz4_unpack(stored, size)
        return data, data, b""
    data = codec.decode(stored, base)
    return (data, data, codec.literals(stored)) if len(data) == size else (None, None, b"")


_CODED = f"{STORED}, buffer binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*STORED_NAMES, "buffer"])


def _level(df: DataFrame, one, grown: bool) -> DataFrame:
    """The rows (STORED and base: the buffer of the base) coded, with the buffer that chunks below build on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for chunk, kind, base_id, size, stored, base in zip(*(b.column(c).to_pylist() for c in (*STORED_NAMES, "base")), strict=True):
                if base_id is not None and base is None:
                    out.append((chunk, kind, base_id, size, None, None))
                    continue
                own, data, added = one(stored, size, base)
                out.append((chunk, kind, base_id, size, own, base + added if grown and base is not None else data))
            if out:
                yield _batch(out)

    return df.select(*STORED_NAMES, "base").mapInArrow(run, _CODED)


def _down_trees(df: DataFrame, one, grown: bool) -> DataFrame:
    """Codes every chunk behind its base (STORED, buffer). Bases have smaller ids, so a tree is one pass in order of ids;
    trees of more than TREE_BYTES go level by level instead, read from a table with a folder for each depth."""
    at = chains(df.where("base_id is not null").select("chunk_id", "base_id"))
    placed = df.join(at.select(F.col("node").alias("chunk_id"), "root", "depth"), "chunk_id", "left").withColumn("root", F.coalesce("root", "chunk_id")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    large = to_checkpoint(placed.groupBy("root").agg(F.sum("chunk_size").alias("n")).where(F.col("n") > TREE_BYTES).select("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held = None, {}
        for b in batches:
            out = []
            for tree, chunk, kind, base_id, size, stored in zip(*(b.column(c).to_pylist() for c in ("root", *STORED_NAMES)), strict=True):
                if tree != root:
                    root, held = tree, {}
                base = None if base_id is None else held.get(base_id)
                if base_id is not None and base is None:
                    own = buffer = None
                else:
                    own, data, added = one(stored, size, base)
                    buffer = base + added if grown and base is not None else data
                held[chunk] = buffer
                out.append((chunk, kind, base_id, size, own, None))
            if out:
                yield _batch(out)

    small = placed.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root", "chunk_id")
    done = small.select("root", *STORED_NAMES).mapInArrow(run, _CODED)
    if large.isEmpty():
        return done
    levels = parted(placed.join(large, "root", "left_semi"), "depth")
    level = to_checkpoint(_level(levels.where("depth = 0").withColumn("base", F.lit(None).cast("binary")), one, grown))
    done = done.unionByName(level)
    for d in range(1, levels.agg(F.max("depth")).first()[0] + 1):
        base = level.select(F.col("chunk_id").alias("base_id"), F.col("buffer").alias("base"))
        level = to_checkpoint(_level(levels.where(F.col("depth") == d).join(base, "base_id", "left"), one, grown))
        done = done.unionByName(level)
    return done


def with_ancestors(wanted: DataFrame, edges: DataFrame, cut=to_checkpoint) -> DataFrame:
    """chunk_id of the wanted chunks and of all bases that they build on (edges: chunk_id, base_id). Ancestors 1, 2, 4, ...
    steps up are joined in turn, so a chain of n takes log2(n) rounds."""
    found = cut(wanted.select("chunk_id").distinct())
    jump = cut(edges.where("base_id is not null").select("chunk_id", "base_id"))
    while not jump.isEmpty():
        found = cut(found.unionByName(found.join(jump, "chunk_id").select(F.col("base_id").alias("chunk_id"))).distinct())
        again = jump.select(F.col("chunk_id").alias("base_id"), F.col("base_id").alias("next"))
        jump = cut(jump.join(again, "base_id").select("chunk_id", F.col("next").alias("base_id")))
    return found


def read_chunks(stored: DataFrame, wanted: DataFrame, grown: bool = False) -> DataFrame:
    """chunk_id, payload of the wanted chunks; only they and their bases are read and decoded."""
    needed = with_ancestors(wanted, stored.select("chunk_id", "base_id"))
    return decode_stored(stored.join(needed, "chunk_id", "left_semi"), grown).join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi")


def read_meta(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """All about the wanted chunks but their bytes, which are not read: kind, base, sizes, and whether LZ4 packs them."""
    few = stored.drop("stored") if "stored" in stored.columns else stored
    return few.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("is_lz4", F.col("kind") == "BASE_LZ4")


def write_containers(chunks: DataFrame, path: str) -> None:
    """Payloads with their places, one folder for each container."""
    chunks.repartition("container_id").sortWithinPartitions("container_id", "container_offset").write.mode("overwrite").partitionBy("container_id").parquet(path)


def read_containers(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The wanted chunks (chunk_id, container_id); only their containers are read."""
    return spark.read.parquet(path).join(wanted, ["container_id", "chunk_id"], "left_semi")


def container_loads(reads: DataFrame) -> DataFrame:
    """One row: chunks read (chunk_id, container_id), containers loaded for them, and the share of reads that met a container
    already loaded, if none is loaded twice."""
    n, k = F.count("*"), F.countDistinct("container_id")
    return reads.agg(n.alias("reads"), k.alias("loads"), F.when(n > 0, (n - k) / n).alias("hit_rate"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_report(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("append").json(path)
