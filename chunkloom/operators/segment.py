"""Segmenters: files (version_no, file_id, content) to ordered chunks (version_no, file_id, seq, offset, chunk_size, payload)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.features import gear32

CHUNKS = "version_no int, file_id long, seq long, offset long, chunk_size long, payload binary"


def fixed(files: DataFrame, size: int = 8192) -> DataFrame:
    """Chunks of `size` bytes, the last one shorter; native expressions only."""
    b = F.col("content")
    at = F.explode(F.sequence(F.lit(0), F.length(b) - 1, F.lit(size)))
    return (
        files.where(F.length(b) > 0).select("version_no", "file_id", "content", at.alias("offset"))
        .select("version_no", "file_id", (F.col("offset") / size).cast("long").alias("seq"), F.col("offset").cast("long").alias("offset"), F.substring(b, F.col("offset") + 1, F.lit(size)).alias("payload"))
        .select("version_no", "file_id", "seq", "offset", F.length("payload").cast("long").alias("chunk_size"), "payload")
    )


@dataclass(frozen=True)
class Cdc:
    """Content-defined cuts: behind the first byte at or after `least` bytes whose rolling hash meets the mask, at `most`
    bytes otherwise. The hash of a byte sums the gear values from the chunk's byte `least` on, each halved (rounded
    down) by every byte since."""

    least: int = 4096
    mask: int = 0xFFF
    most: int = 16384


FASTCDC, GEARCDC = Cdc(), Cdc(0, 0x1FFF, 1 << 62)
#: For small files.
SMALL_FASTCDC, SMALL_GEARCDC = Cdc(128, 0x7F, 1024), Cdc(0, 0xFF, 1 << 62)


@lru_cache(1)
def _gear_list() -> list[int]:
    return gear32().tolist()


def cut_points(data: bytes, rule: Cdc) -> list[int]:
    """Ends of the chunks."""
    gear, n, out, start = _gear_list(), len(data), [], 0
    mask, least, most = rule.mask, rule.least, rule.most
    while start < n:
        cut = stop = min(n, start + most)
        begin = min(start + least, stop)
        while begin < stop:  # in parts, so that a short chunk of a long file copies little
            part = data[begin : min(stop, begin + 1024)]
            fp = 0 if begin == start + least else fp  # noqa: F821
            i = begin
            for x in part:
                i += 1
                fp = (fp >> 1) + gear[x]
                if not fp & mask:
                    cut = i
                    break
            else:
                begin += len(part)
                continue
            break
        out.append(cut)
        start = cut
    return out


#: Bytes of files whose chunks are returned in one batch.
BATCH_BYTES = 4 << 20


def _rows(held: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    """A batch of (version_no, file_id, seq, offset, payload)."""
    v, f, seq, offset, data = zip(*held, strict=True)
    sizes = [len(x) for x in data]
    arrays = [pa.array(v, pa.int32()), *(pa.array(x, pa.int64()) for x in (f, seq, offset, sizes)), pa.array(data, pa.binary())]
    held.clear()
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in CHUNKS.split(", ")])


def content_defined(files: DataFrame, rule: Cdc = FASTCDC) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        size = 0
        for b in batches:
            for v, f, data in zip(*(b.column(c) for c in ("version_no", "file_id", "content")), strict=True):
                v, f, data, at = v.as_py(), f.as_py(), data.as_py() or b"", 0
                for seq, end in enumerate(cut_points(data, rule)):
                    held.append((v, f, seq, at, data[at:end]))
                    at = end
                size += len(data)
                if size >= BATCH_BYTES and held:
                    yield _rows(held)
                    size = 0
        if held:
            yield _rows(held)

    return files.select(F.col("version_no").cast("int"), F.col("file_id").cast("long"), "content").mapInArrow(run, CHUNKS)


def content_defined_windows(windows: DataFrame, rule: Cdc = FASTCDC) -> DataFrame:
    """Chunks as content_defined() gives them, of files that come in windows (version_no, file_id, window, last, content). A
    file's windows stream through one task in order; it holds one window and what the last cut left, not the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rest, offset, seq = None, b"", 0, 0
        for b in batches:
            for v, f, last, data in zip(*(b.column(c).to_pylist() for c in ("version_no", "file_id", "last", "content")), strict=True):
                if (v, f) != key:
                    key, rest, offset, seq = (v, f), b"", 0, 0
                data = rest + (data or b"")
                ends = cut_points(data, rule)
                if not last and ends:
                    ends.pop()  # where the data ends; what comes next decides
                held, at = [], 0
                for end in ends:
                    held.append((v, f, seq, offset + at, data[at:end]))
                    at, seq = end, seq + 1
                if held:
                    yield _rows(held)
                rest, offset = data[at:], offset + at

    ordered = windows.select(F.col("version_no").cast("int"), F.col("file_id").cast("long"), "window", "last", "content").repartition("version_no", "file_id").sortWithinPartitions("version_no", "file_id", "window")
    return ordered.mapInArrow(run, CHUNKS)
