"""Suffix-array dedup: bytes in strings of LENGTH bytes that start earlier too.

Each shard (see repeats.py) holds the distinct segments whose strings share anchors. Their common prefixes are derived
from the Burrows-Wheeler transform alone, by increasing value: starting from the intervals of single bytes, a breadth
first round extends every interval to the left by each byte before it; an end of a new interval that no shorter string
has marked divides suffixes with just that many bytes in common. The rounds stop at LENGTH: ends not marked by then
lie within groups of suffixes that share LENGTH bytes, and the earliest place of a group is its first occurrence.

Defined results: null texts are empty; texts under LENGTH bytes lose nothing; of equal texts the one with the smallest
doc_id stays; a null doc_id comes before all others; rows with one doc_id are compared by start alone, so a string there
is removed if it starts at a smaller byte number in any of them, and strings that start at the same one in several of
them all stay; what is kept may cut a UTF-8 sign, so it is bytes; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm.bwt import Bwt
from chunkloom.llm.repeats import Unit, Units, remove_repeats

LENGTH, GRAM = 100, 32


def bounded_intervals(b: Bwt, length: int) -> np.ndarray:
    """For each row (and the end), whether it has fewer than `length` symbols in common with the row before."""
    divided = np.zeros(b.n + 1, bool)
    divided[0] = divided[b.n] = True
    divided[: b.marks + 1] = True  # marks differ from each other
    some = np.flatnonzero(np.diff(b.first_row)[1:]) + 1
    lo = np.concatenate((np.arange(b.marks), b.first_row[some]))
    hi = np.concatenate((np.arange(b.marks) + 1, b.first_row[some + 1]))
    divided[hi] = True
    step = b.steps()
    alone = lo[hi - lo == 1]  # intervals of one row have one extension: a step on the transform
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    for _ in range(1, length):
        if not len(lo) and not len(alone):
            break
        alone = step[alone]
        # rows before which the same symbol stands (no mark) stay together, so they have one extension, too
        head, tail = step[lo], step[hi - 1]
        one = (b.symbol[lo] == b.symbol[hi - 1]) & (tail - head == hi - 1 - lo)
        two = ~one & (hi - lo == 2)  # different symbols: two intervals of one row
        alone = np.concatenate((alone, step[lo[two]], step[hi[two] - 1]))
        more = ~one & ~two
        symbol, low, high = b.tree.symbols(lo[more], hi[more])
        some = symbol > 0
        shift = b.shift[symbol[some]]
        lo, hi = np.concatenate((head[one], shift + low[some])), np.concatenate((tail[one] + 1, shift + high[some]))
        # ends of two intervals of one round differ, as do their strings
        alone = alone[alone >= 0]
        alone = alone[~divided[alone + 1]]
        new = ~divided[hi]
        lo, hi = lo[new], hi[new]
        divided[alone + 1] = True
        divided[hi] = True
        alone = np.concatenate((alone, lo[hi - lo == 1]))
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    return divided


def first_places(code: np.ndarray, size: np.ndarray, count: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """The first place of every string of `length` symbols."""
    b = Bwt(code, size, length)
    divided = bounded_intervals(b, length)[: b.n]
    begin = np.flatnonzero(divided)
    whole = np.full(b.n, np.iinfo(np.int64).max)  # places, with the marks
    whole[np.arange(len(place)) + np.repeat(np.arange(len(size)), size)] = place
    earliest = np.minimum.reduceat(whole[b.sa], begin)
    group = np.cumsum(divided) - 1
    ends = np.cumsum(count)
    at = np.arange(int(count.sum())) + np.repeat(b.start - (ends - count), count)
    return earliest[group[b.rank[at]]]


UNIT = Unit(words=False, length=LENGTH, gram=GRAM)


def _spans(gone: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of maximal removed runs of each text."""
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    edges = first[1:-1]
    edges = edges[edges < len(gone)]
    rise[edges] = gone[edges]
    total = np.concatenate(([0], np.cumsum(rise)))
    return total[first[1:]] - total[first[:-1]]


def _finish(batch: pa.RecordBatch, u: Units, gone: np.ndarray, wanted: str) -> pa.RecordBatch:
    lost = np.concatenate(([0], np.cumsum(gone)))
    first = u.first
    n, out = np.diff(first), []
    for i in range(batch.num_rows):
        lo, hi = first[i], first[i + 1]
        own = u.data[lo:hi]
        out.append((own if lost[lo] == lost[hi] else own[~gone[lo:hi]]).tobytes())
    last = pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string()) if wanted == "kept_sha256" else pa.array(out, pa.binary())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost[first[1:]] - lost[first[:-1]], pa.int64()), pa.array(_spans(gone, first), pa.int64()), last], ["doc_id", "n_bytes", "n_removed", "n_spans", wanted])


def _run(docs: DataFrame, wanted: str, kind: str) -> DataFrame:
    few = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return remove_repeats(few, UNIT, first_places, lambda b, u, g: _finish(b, u, g, wanted), f"doc_id long, n_bytes long, n_removed long, n_spans long, {wanted} {kind}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _run(docs, "kept_sha256", "string")


def kept(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    return _run(docs, "kept", "binary")
