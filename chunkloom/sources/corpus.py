"""Files as rows: version_no, file_id, path, content. Versions follow the natural order of their names."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def natural_key(path: Column) -> Column:
    """Sorts case-insensitively, with runs of digits by their value (up to 20 digits)."""
    parts = F.regexp_extract_all(F.upper(path), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x)), "")


def directory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All regular files below a folder; one version each, in natural order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content")
    # numbering needs the names only; contents join afterwards
    names = files.select("path").withColumn("version_no", F.row_number().over(Window.orderBy(natural_key(F.col("path")), "path")) - 1)
    return files.join(names, "path").select("version_no", F.col("version_no").cast("long").alias("file_id"), "path", "content")


WINDOW = 64 << 20


def windows(spark: SparkSession, root: str, glob: str = "*", size: int = WINDOW) -> DataFrame:
    """version_no, file_id, path, window, last, content: files of any size in parts of `size` bytes, each read by a range of
    its own, so no row holds a whole file. For segment.content_defined_windows()."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    named = files.withColumn("version_no", F.row_number().over(Window.orderBy(natural_key(F.col("path")), "path")) - 1)  # names only
    parts = named.where("length > 0").select("version_no", "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("window"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, path, n, w in zip(*(b.column(c).to_pylist() for c in ("version_no", "path", "length", "window")), strict=True):
                system, name = fs.FileSystem.from_uri(quote(path, safe=":/%"))
                with system.open_input_file(name) as f:
                    data = f.read_at(min(size, n - w * size), w * size)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), pa.array([v], pa.int64()), pa.array([path]), pa.array([w], pa.int64()), pa.array([(w + 1) * size >= n]), pa.array([data], pa.binary())], ["version_no", "file_id", "path", "window", "last", "content"])

    return parts.repartition("version_no", "window").mapInArrow(run, "version_no int, file_id long, path string, window long, last boolean, content binary")


def versions(df: DataFrame, name: str) -> DataFrame:
    """name, version_no of each distinct version name."""
    return df.select(F.col(name)).distinct().withColumn("version_no", F.row_number().over(Window.orderBy(natural_key(F.col(name)), name)) - 1)


def from_table(df: DataFrame, version: str, file_id: str, text: str) -> DataFrame:
    """Rows of a table as files; the version column's values in natural order are the versions."""
    v = versions(df, version).withColumnRenamed(version, "_v")
    return df.join(v, df[version].eqNullSafe(F.col("_v"))).select("version_no", df[file_id].alias("file_id"), df[version].alias("path"), F.encode(F.coalesce(df[text], F.lit("")), "utf-8").alias("content"))


def first_versions(files: DataFrame, n: int) -> DataFrame:
    return files.where(F.col("version_no") < n)
