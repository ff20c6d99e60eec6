"""Tar archives: members to blocks, headers gathered into header chunks, headers moved behind the data, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators import dedup
from chunkloom.operators.segment import FASTCDC, Cdc, cut_points

BLOCK, BIG = 512, 4 << 20
#: Member types with a body.
BODY_TYPES = (b"0", b"x", b"L")


def blocks(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(kind, offset, size, member name) in file order; kind is header or body. Bodies are rounded up to whole blocks;
    an old-style member (type NUL) and the closing zeros have no body. The body of a member of type L is the name of the
    member behind it, whose own field has room for 100 bytes only; the two headers and bodies share that name."""
    at, long_name = 0, None
    while at + BLOCK <= len(data):
        head = data[at : at + BLOCK]
        size = 0
        if head[156:157] in BODY_TYPES:
            digits = head[124:135].strip(b" \0") or b"0"
            try:
                size = int(digits, 8)
            except ValueError:
                size = 0
        whole = min(-(-size // BLOCK) * BLOCK, len(data) - at - BLOCK)
        if head[156:157] == b"L":
            long_name = data[at + BLOCK : at + BLOCK + min(size, whole)].split(b"\0", 1)[0].decode("utf-8", "replace")
            name = long_name
        else:
            name = head[:100].split(b"\0", 1)[0].decode("utf-8", "replace") if long_name is None else long_name
            long_name = None
        yield "header", at, BLOCK, name
        at += BLOCK
        if whole:
            yield "body", at, whole, name
            at += whole
    if at < len(data):
        yield "body", at, len(data) - at, ""


def tar_chunks(data: bytes, headers: int = 0, rule: Cdc = FASTCDC) -> list[tuple[str, int, bytes, str]]:
    """(kind, offset, payload, name). With headers=0 each header is a chunk; else up to that many headers in a row of the
    file gather in one header chunk, given behind the bodies met meanwhile. Bodies over BIG bytes are cut by content."""
    out: list[tuple[str, int, bytes, str]] = []
    held: list[tuple[int, bytes, str]] = []

    def close() -> None:
        if held:
            out.append(("header", held[0][0], b"".join(h for _, h, _ in held), held[0][2]))
            held.clear()

    for kind, at, size, name in blocks(data):
        part = data[at : at + size]
        if kind == "header":
            if not headers:
                out.append((kind, at, part, name))
                continue
            if len(held) >= headers:
                close()
            held.append((at, part, name))
        elif size <= BIG:
            out.append((kind, at, part, name))
        else:
            close()
            start = 0
            for end in cut_points(part, rule):
                out.append(("big", at + start, part[start:end], name))
                start = end
    close()
    return out


def split_headers(data: bytes) -> bytes:
    """The archive rewritten: length of the data region (8 bytes, little-endian), all bodies, all headers."""
    found = list(blocks(data))
    bodies = b"".join(data[at : at + n] for kind, at, n, _ in found if kind == "body")
    return struct.pack("<Q", len(bodies)) + bodies + b"".join(data[at : at + n] for kind, at, n, _ in found if kind == "header")


def join_headers(data: bytes) -> bytes:
    """The archive that split_headers() was given."""
    (n,) = struct.unpack_from("<Q", data)
    bodies, heads, at, out = data[8 : 8 + n], data[8 + n :], 0, []
    for i in range(0, len(heads), BLOCK):
        head = heads[i : i + BLOCK]
        out.append(head)
        if head[156:157] in BODY_TYPES:
            try:
                size = int(head[124:135].strip(b" \0") or b"0", 8)
            except ValueError:
                size = 0
            size = min(-(-size // BLOCK) * BLOCK, len(bodies) - at)
            out.append(bodies[at : at + size])
            at += size
    out.append(bodies[at:])
    return b"".join(out)


def weave(headers: bytes, bodies: bytes) -> bytes:
    """The archive whose headers and bodies these are, each in order."""
    return join_headers(struct.pack("<Q", len(bodies)) + bodies + headers)


def restore_archives(recipe: DataFrame, payloads: DataFrame) -> DataFrame:
    """version_no, file_id, content: archives from their recipes (version_no, file_id, seq, chunk_id, part), whose headers
    and bodies are joined apart and woven into one another again."""
    streams = dedup.restore(recipe, payloads, ("version_no", "file_id", "part"))
    side = lambda part: streams.where(F.col("part") == part).select("version_no", "file_id", F.col("content").alias(part))
    both = side("header").join(side("data"), ["version_no", "file_id"], "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [weave(h or b"", d or b"") for h, d in zip(b.column("header").to_pylist(), b.column("data").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("version_no"), b.column("file_id"), pa.array(out, pa.binary())], ["version_no", "file_id", "content"])

    return both.mapInArrow(run, "version_no int, file_id long, content binary")


ARCHIVE_CHUNKS = "version_no int, file_id long, seq long, kind string, offset long, chunk_size long, name string, payload binary"


def tar_segments(files: DataFrame, headers: int = 0, rule: Cdc = FASTCDC) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, f, data in zip(*(b.column(c).to_pylist() for c in ("version_no", "file_id", "content")), strict=True):
                rows = tar_chunks(data or b"", headers, rule)
                n = len(rows)
                yield pa.RecordBatch.from_pydict({
                    "version_no": pa.array([v] * n, pa.int32()), "file_id": pa.array([f] * n, pa.int64()), "seq": pa.array(range(n), pa.int64()), "kind": pa.array([r[0] for r in rows], pa.string()),
                    "offset": pa.array([r[1] for r in rows], pa.int64()), "chunk_size": pa.array([len(r[2]) for r in rows], pa.int64()), "name": pa.array([r[3] for r in rows], pa.string()), "payload": pa.array([r[2] for r in rows], pa.binary())})

    return files.select(F.col("version_no").cast("int"), F.col("file_id").cast("long"), "content").mapInArrow(run, ARCHIVE_CHUNKS)


def rewrite(files: DataFrame, back: bool = False) -> DataFrame:
    """files with contents whose headers stand behind the data (or the other way round)."""
    f = join_headers if back else split_headers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("content")
            yield pa.RecordBatch.from_arrays([pa.array([f(x or b"") if back is False or x else b"" for x in c.to_pylist()], pa.binary()) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return files.mapInArrow(run, files.schema)
