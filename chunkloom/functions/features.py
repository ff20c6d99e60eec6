"""Resemblance features of chunks, vectorised over all chunks of an Arrow batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Multipliers and addends of the twelve linear transforms.
TRANSFORM_A = (
    0x086B1D783F0B36F8, 0x2B7284FE29291B48, 0x21E69BA2CE4DCA8A, 0xABF415839B934014, 0xACE04E7EC1042A94, 0xD501CA19FCF3247E,
    0x7EE21A94E0F7B876, 0xF89F0A9E406BFE79, 0x519812D9679C19A9, 0x946B091FAC9E2562, 0x9895C8EDC12046DA, 0xF14B07FBA4C9CAD6,
)
TRANSFORM_B = (
    0xA218DBBC13A36BCD, 0xB52E8940AFB2B6D3, 0x1889E1CB2666C225, 0x85E2C0B13C289B09, 0xD0CC079D42E332B0, 0xFF6D280A310ECAAC,
    0xE9B27AEF6283D994, 0xB10E401778ED5018, 0x1F2319CD7659FF7D, 0x910882F3C77B16D7, 0xBC3903F615851703, 0x0103F9F6540F65CC,
)
SAMPLE_MASK = 0x0000400303410000
FEATURES, MIN_SIZE = 12, 60
FINESSE_BASE, FINESSE_MOD, FINESSE_WINDOW = 37, 1_000_000_007, 48
POLY_BASE, POLY_WINDOW = 257, 64


def gear64() -> np.ndarray:
    """The 256 gear values, by rule: the first eight bytes of MD5 of 'gear64-' and the byte's number."""
    return np.array([int.from_bytes(hashlib.md5(f"gear64-{i}".encode()).digest()[:8], "big") for i in range(256)], np.uint64)


def gear32() -> np.ndarray:
    """As gear64(), the first four bytes of MD5 of 'gear32-' and the number, with the top bit clear."""
    return np.array([int.from_bytes(hashlib.md5(f"gear32-{i}".encode()).digest()[:4], "big") & 0x7FFFFFFF for i in range(256)], np.uint64)


def _sampled(chunks: list[bytes], mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(chunk number, hash) of the sampled positions, in order. The hash of a position sums the gear values of the last
    64 bytes, shifted by their distance; six doublings give it for all positions at once."""
    sizes = np.array([len(c) for c in chunks], np.int64)
    starts = np.cumsum(sizes + 64) - sizes  # 64 zeros before each chunk
    total = int((sizes + 64).sum())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = np.zeros(total, np.uint64)
    at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    g[at] = gear64()[np.frombuffer(b"".join(chunks), np.uint8)]
    for k in (1, 2, 4, 8, 16, 32):
        g[k:] += g[:-k] << np.uint64(k)
    h = g[at]
    hit = np.flatnonzero((h & np.uint64(mask)) == 0)
    return np.repeat(np.arange(len(chunks)), sizes)[hit], h[hit]


def odess(chunks: list[bytes], mask: int = SAMPLE_MASK) -> np.ndarray:
    """Twelve features of each chunk: the maxima of the transforms over sampled positions, 0 without any."""
    owner, h = _sampled(chunks, mask)
    out = np.zeros((len(chunks), FEATURES), np.uint64)
    if len(h):
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        for j in range(FEATURES):
            out[owner[begin], j] = np.maximum.reduceat(h * np.uint64(TRANSFORM_A[j]) + np.uint64(TRANSFORM_B[j]), begin)
    return out


def finesse(chunk: bytes) -> list[int]:
    """The largest rolling hash of each twelfth of the chunk; 0 for a part shorter than the window."""
    b = np.frombuffer(chunk, np.uint8).astype(np.int64)
    out = []
    powers = np.array([pow(FINESSE_BASE, FINESSE_WINDOW - 1 - i, FINESSE_MOD) for i in range(FINESSE_WINDOW)], np.int64)
    for i in range(FEATURES):
        part = b[len(b) * i // FEATURES : len(b) * (i + 1) // FEATURES]
        if len(part) < FINESSE_WINDOW:
            out.append(0)
        else:
            windows = np.lib.stride_tricks.sliding_window_view(part, FINESSE_WINDOW)
            out.append(int((windows * powers % FINESSE_MOD).sum(axis=1).__mod__(FINESSE_MOD).max()))
    return out


def ntransform(chunk: bytes) -> list[int]:
    """For each transform, the low 32 bits of the window hash at which it is largest (the first of equals). The last
    window takes no part, so chunks up to the window's length give zeros."""
    n = len(chunk) - POLY_WINDOW
    if n <= 0:
        return [0] * FEATURES
    b = np.frombuffer(chunk, np.uint8).astype(np.uint64)
    fp = np.zeros(n, np.uint64)
    for j in range(POLY_WINDOW):
        fp = fp * np.uint64(POLY_BASE) + b[j : j + n]
    out = []
    for a, c in zip(TRANSFORM_A, TRANSFORM_B, strict=True):
        value = (fp * np.uint64(a) + np.uint64(c)) & np.uint64(0xFFFFFFFF)
        out.append(int(fp[int(value.argmax())]) & 0xFFFFFFFF if value.any() else 0)
    return out


#: Bytes of chunks whose hashes, eight bytes for each byte, are there at once.
SLICE_BYTES = 1 << 20


def _slices(chunks: pd.Series) -> Iterator[list[bytes]]:
    """The chunks in parts of about SLICE_BYTES, one chunk at least."""
    held: list[bytes] = []
    size = 0
    for c in chunks:
        held.append(bytes(c))
        size += len(c)
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


@F.pandas_udf(T.ArrayType(T.LongType()))
def odess_features(chunks: pd.Series) -> pd.Series:
    return pd.Series([f for part in _slices(chunks) for f in odess(part).view(np.int64)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def sampled_features(chunks: pd.Series) -> pd.Series:
    out = []
    for part in _slices(chunks):
        owner, h = _sampled(part, SAMPLE_MASK)
        out += np.split(h.view(np.int64), np.searchsorted(owner, np.arange(1, len(part))))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def finesse_features(chunks: pd.Series) -> pd.Series:
    return chunks.map(lambda c: finesse(bytes(c)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def ntransform_features(chunks: pd.Series) -> pd.Series:
    return chunks.map(lambda c: ntransform(bytes(c)))


# ---- super-features: only their equality matters


def grouped(f: Column, size: int) -> Column:
    """Hashes of consecutive groups of `size` of the twelve features."""
    return F.array(*[F.xxhash64(*[f[i + j] for j in range(size)]) for i in range(0, FEATURES, size)])


def odess_super(f: Column) -> Column:
    return grouped(f, 4)


def ntransform_super(f: Column) -> Column:
    return F.array(*[F.xxhash64(*[f[j * 3 + i] for j in range(4)]) for i in range(3)])


def finesse_super(f: Column) -> Column:
    """The i-th ranked feature of each group of three, hashed by rank."""
    groups = [F.array_sort(F.slice(f, 1 + 3 * g, 3)) for g in range(4)]
    return F.array(*[F.sha2(F.concat_ws(",", *[g[i].cast("string") for g in groups]), 256) for i in range(3)])


def tiered_super(f: Column) -> Column:
    """(tier, pos, sf): three groups of 4, four of 3 and six of 2."""
    out = []
    for tier, size in ((1, 4), (2, 3), (3, 2)):
        out += [F.struct(F.lit(tier).alias("tier"), F.lit(i // size).alias("pos"), F.xxhash64(F.lit(tier), *[f[i + j] for j in range(size)]).alias("sf")) for i in range(0, FEATURES, size)]
    return F.array(*out)
