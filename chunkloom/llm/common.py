"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python slices each Arrow batch so that no more text than this is unpacked at once.
SLICE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir. Where the session names none, a local session (tests, a laptop) gets a folder of its
    own; on a cluster that is an error, as the folder has to be shared."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    sc.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "chunkloom-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return few_files(df).checkpoint(eager=True)


def few_files(df: DataFrame) -> DataFrame:
    """df in an eighth of the session's shuffle partitions, but four for each core at least, without a shuffle: a task
    writes what several partitions hold, one after the other. Each file costs some calls of the file system."""
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, fan_out(df) // 8))


def fan_out(df: DataFrame, floor: int = 12) -> int:
    """Reduce partitions for a keyed exchange: follows the session's setting, which the cluster sizes to its data."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose named string or binary column holds about limit bytes (one row at least)."""
    import numpy as np

    n = batch.num_rows
    if not n:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, such that the memory it frees goes back to the system. Workers are reused, an executor has
    several of them, and both Arrow's pool and the C library would keep what the largest task took."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
                if trim is not None:
                    trim(0)

    return tidy


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as set it apart from all columns taken."""
    lower, out = {t.lower() for t in taken}, []
    for n in names:
        n = f"_{n}"
        while n.lower() in lower:
            n = f"_{n}"
        out.append(n)
    return out
