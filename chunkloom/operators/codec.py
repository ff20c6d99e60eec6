"""Lossless codecs: LZ4 blocks, and deltas against a base as COPY and ADD runs with the added bytes apart."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LZ4 = pa.Codec("lz4_raw")
STEP = 16


def lz4_size(data: bytes) -> int:
    """Stored size: the compressed one, or the raw one if that is not larger."""
    return min(len(data), len(_LZ4.compress(data, asbytes=True))) if data else 0


def lz4_pack(data: bytes) -> bytes:
    """The LZ4 block, or the raw bytes if that is not smaller; unpacked by their sizes."""
    small = _LZ4.compress(data, asbytes=True) if data else b""
    return small if len(small) < len(data) else data


def lz4_unpack(stored: bytes, size: int) -> bytes:
    return stored if len(stored) == size else _LZ4.decompress(stored, size, asbytes=True)


def add_blocks(known: dict[bytes, int], base: bytes | bytearray, start: int = 0) -> None:
    """The places of base's blocks of STEP bytes from `start` (a multiple of STEP); of equal blocks the first counts."""
    for i in range(start, len(base) - STEP + 1, STEP):
        known.setdefault(bytes(base[i : i + STEP]), i)


def delta_parts(target: bytes, base: bytes | bytearray, known: dict[bytes, int] | None = None) -> tuple[list[tuple[int, int, int]], bytes]:
    """Runs (copy offset or -1, length, place among the added bytes) and the added bytes.

    Blocks of STEP bytes of the base are known by content; a match at any target byte grows both ways."""
    if known is None:
        add_blocks(known := {}, base)
    runs: list[tuple[int, int, int]] = []
    added = bytearray()
    at = lit = 0
    n = len(target)
    while at + STEP <= n:
        src = known.get(target[at : at + STEP])
        if src is None:
            at += 1
            continue
        back = 0
        while at - back > lit and src - back > 0 and target[at - back - 1] == base[src - back - 1]:
            back += 1
        size = STEP
        while at + size < n and src + size < len(base) and target[at + size] == base[src + size]:
            size += 1
        if at - back > lit:
            runs.append((-1, at - back - lit, len(added)))
            added += target[lit : at - back]
        runs.append((src - back, size + back, 0))
        at += size
        lit = at
    if lit < n:
        runs.append((-1, n - lit, len(added)))
        added += target[lit:]
    return runs, bytes(added)


def encode(target: bytes, base: bytes) -> bytes:
    return pack(*delta_parts(target, base))


def pack(runs: list[tuple[int, int, int]], added: bytes) -> bytes:
    ops = b"".join(struct.pack("<iI", src, size) for src, size, _ in runs)
    return struct.pack("<I", len(runs)) + zlib.compress(ops + added, 6)


def decode(delta: bytes, base: bytes) -> bytes:
    (n,) = struct.unpack_from("<I", delta)
    raw = zlib.decompress(delta[4:])
    out, at = bytearray(), 8 * n
    for src, size in struct.iter_unpack("<iI", raw[: 8 * n]):
        if src < 0:
            out += raw[at : at + size]
            at += size
        else:
            out += base[src : src + size]
    return bytes(out)


def added_bytes(target: bytes, base: bytes) -> bytes:
    """The literal section of a delta."""
    return delta_parts(target, base)[1]


def literals(delta: bytes) -> bytes:
    """The same, read from the packed delta."""
    (n,) = struct.unpack_from("<I", delta)
    return zlib.decompress(delta[4:])[8 * n :]


def block_delta_size(target: Column, base: Column) -> Column:
    """Size of a delta in the block codec, in native expressions: 4 bytes, 4 for each block of STEP bytes that the base has
    at a block's place, and 1 more than their length for the others. Null without a base."""
    blocks = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(0), F.length(x) - 1, F.lit(STEP)), lambda i: F.substring(x, i + 1, F.lit(STEP)))).otherwise(F.array().cast("array<binary>"))
    # hex strings, as arrays of binary values cannot be searched
    known = F.transform(blocks(base), F.hex)
    size = F.lit(4) + F.aggregate(blocks(target), F.lit(0), lambda n, z: n + F.when(F.array_contains(known, F.hex(z)), 4).otherwise(F.length(z) + 1))
    return F.when(base.isNotNull(), size)


@F.pandas_udf(T.LongType())
def lz4_sizes(data: pd.Series) -> pd.Series:
    return data.map(lambda x: lz4_size(bytes(x)))


@F.pandas_udf(T.LongType())
def delta_sizes(target: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([len(encode(bytes(t), bytes(b))) for t, b in zip(target, base, strict=True)], dtype="int64")


@F.pandas_udf(T.BinaryType())
def delta_encode(target: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([encode(bytes(t), bytes(b)) for t, b in zip(target, base, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def delta_decode(delta: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([decode(bytes(d), bytes(b)) for d, b in zip(delta, base, strict=True)], dtype=object)
