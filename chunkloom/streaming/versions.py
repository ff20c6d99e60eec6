"""Versions arriving one after the other: each micro-batch is de-duplicated against all earlier ones.

The fingerprint index is a folder of Parquet parts, one for each batch, so first occurrence holds for ever without
unbounded operator state, and a batch that is run again writes the same parts anew: its new fingerprints, their bytes,
and the recipes of its files.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkloom.operators import dedup, metrics, segment


class IncrementalDedup:
    def __init__(self, spark: SparkSession, root: str, size: int = 8192) -> None:
        self.spark, self.root, self.size = spark, root.rstrip("/"), size

    def _known(self, before: int) -> DataFrame:
        schema = "fp string, version_no int, file_id long, seq long, chunk_size long, copies long, batch long"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/index")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/index").where(F.col("batch") < before)

    def process(self, files: DataFrame, batch: int) -> None:
        """Adds one batch of files (version_no, file_id, content)."""
        began = time.monotonic()
        whole = dedup.fingerprinted(segment.fixed(files, self.size))
        chunks = whole.drop("payload").persist()
        first = dedup.first_occurrences(chunks).select("fp", "first.*", "chunk_size", "copies")
        new = first.join(self._known(batch).select("fp"), "fp", "left_anti")
        new.write.mode("overwrite").parquet(f"{self.root}/index/batch={batch}")
        # the batch's containers and recipes: new chunks with their bytes, and all places with their content's name
        whole.join(new.select(*dedup.PLACE), dedup.PLACE).select("fp", "payload").write.mode("overwrite").parquet(f"{self.root}/chunks/batch={batch}")
        chunks.select(*dedup.PLACE, "fp").write.mode("overwrite").parquet(f"{self.root}/recipes/batch={batch}")
        stored = self.spark.read.parquet(f"{self.root}/index/batch={batch}").agg(F.count("*").alias("new_chunks"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("new_bytes"))
        logical = chunks.agg(F.count("*").alias("logical_chunks"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("logical_bytes"))
        both = logical.crossJoin(stored).withColumn("seconds", F.lit(time.monotonic() - began))
        both.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/batch={batch}")  # one row by one row
        chunks.unpersist()

    def restore(self, batch: int | None = None) -> DataFrame:
        """version_no, file_id, content of the files of one batch, or of all."""
        recipe = self.spark.read.parquet(f"{self.root}/recipes").withColumnRenamed("fp", "chunk_id")
        recipe = recipe if batch is None else recipe.where(F.col("batch") == batch)
        return dedup.restore(recipe, self.spark.read.parquet(f"{self.root}/chunks").withColumnRenamed("fp", "chunk_id"))

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/log")

    def throughput(self) -> DataFrame:
        """Seconds and bytes a second of each batch, until its index part was written."""
        return metrics.throughput(self.log().withColumnRenamed("batch", "version_no"))

    def start(self, files: DataFrame, checkpoint: str) -> StreamingQuery:
        """files: a streaming DataFrame; every trigger is a batch of versions."""
        return files.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
