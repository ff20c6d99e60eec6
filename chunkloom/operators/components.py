"""Checkpoints, and connected components of a table of links."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a local session (tests, a laptop) gets a folder of its own; on
    a cluster that is an error, as the folder has to be shared."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "chunkloom-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, in an eighth of the session's shuffle partitions, but four
    for each core at least; a task writes what several partitions hold."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    files = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    return df.coalesce(files).checkpoint(eager=True)


def parted(df: DataFrame, by: str) -> DataFrame:
    """df written to the checkpoint folder as a table with a folder for each value of a column, of which few are read."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.repartition(by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with a link (a, b: longs), by alternating large and small
    stars. Self links and repeats are allowed; an empty table gives no rows. Each round is written to the checkpoint
    folder; nothing comes to the driver but a count and a checksum."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
