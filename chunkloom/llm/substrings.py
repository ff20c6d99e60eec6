"""Substring dedup: words in windows of LENGTH words that start earlier too, found with an FM-index per shard.

Each shard (see repeats.py) holds the distinct segments whose windows share anchors, as a compressed FM-index: their
Burrows-Wheeler transform in a wavelet tree shaped by an optimal prefix code, packed bits with counts. Its documents'
segments stream through it from right to left: a backward step extends the match by a word, and once LENGTH words
match, the interval is widened to all rows that share them. These are the matching statistics up to the threshold; the
earliest place of an interval of several rows is the window's first occurrence.

Defined results: null, empty and blank texts have no words; texts under LENGTH words lose nothing; of equal texts the
one with the smallest doc_id stays; a null doc_id comes before all others; rows with one doc_id are compared by start
alone, so a window there is removed if it starts at a smaller word number in any of them, and windows that start at the
same one in several of them all stay; extra columns are kept or ignored as the function says; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.bwt import FmIndex
from chunkloom.llm.repeats import Unit, Units, remove_repeats

LENGTH, GRAM = 20, 6


def matching_statistics(code: np.ndarray, size: np.ndarray, count: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """The first place of every window of `length` symbols, by backward search of all segments side by side."""
    index = FmIndex(code, size, place, length)
    text = (np.unique(code, return_inverse=True)[1] + 1).astype(np.int32)  # the segments that are streamed
    # all segments at once, longest first, from their last symbol on
    order = np.argsort(-size, kind="stable")
    last, sizes = (np.cumsum(size) - 1)[order], size[order]
    window0 = (np.cumsum(count) - count)[order]
    ends = np.cumsum(count)
    out = place[np.arange(int(count.sum())) + np.repeat(np.cumsum(size) - size - (ends - count), count)]  # their own
    lo = hi = np.empty(0, np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -t, "left"))  # segments longer than t
        symbol = text[last[:m] - t]
        if t == 0:
            lo, hi = index.row[symbol], index.row[symbol + 1]
        else:
            lo, hi = index.extend(symbol, lo[:m], hi[:m])
        if t + 1 >= length:
            several, g = index.shared(lo)
            i = np.flatnonzero(several)
            g = g[i]
            lo[i], hi[i] = index.begin[g], index.end[g]
            out[window0[i] + sizes[i] - 1 - t] = index.earliest[g]
    return out


UNIT = Unit(words=True, length=LENGTH, gram=GRAM)
DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept_words(batch: pa.RecordBatch, u: Units, gone: np.ndarray):
    """(words, number removed, kept words) of each text."""
    lost = np.concatenate(([0], np.cumsum(gone)))
    for i, text in enumerate(batch.column("text").to_pylist()):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        lo, hi = u.first[i], u.first[i + 1]
        n = int(lost[hi] - lost[lo])
        yield len(words), n, (words if not n else list(compress(words, ~gone[lo:hi])))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def finish(batch: pa.RecordBatch, u: Units, gone: np.ndarray) -> pa.RecordBatch:
        rows = [(n, lost, hashlib.sha256(b" ".join(kept)).hexdigest()) for n, lost, kept in _kept_words(batch, u, gone)]
        n, lost, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    few = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return remove_repeats(few, UNIT, matching_statistics, finish, DIGESTS)


def cleaned(docs: DataFrame) -> DataFrame:
    """All columns of docs; texts that lose words are their kept words joined by blanks, all others stay as they are."""

    def finish(batch: pa.RecordBatch, u: Units, gone: np.ndarray) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        for i, (_, lost, kept) in enumerate(_kept_words(batch, u, gone)):
            if lost:
                texts[i] = b" ".join(kept).decode("utf-8", "surrogatepass")
        at = batch.schema.get_field_index("text")
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == at else c for j, c in enumerate(batch.columns)], batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = remove_repeats(docs.withColumn("text", F.col("text").cast("string")), UNIT, matching_statistics, finish, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
