"""Connected components of a table of links: in one task while they are few, else by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import cut, lean

MAX_ROUNDS = 60
#: Up to so many distinct links (16 bytes each) one task joins them; beyond, rounds of stars over all tasks do.
ONE_TASK = 1 << 20


def join_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all links (u, v) that a task reads."""
    ends = [np.stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches if b.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    up = np.arange(len(nodes))
    while (up[u] != up[v]).any():
        a, b = up[u], up[v]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes), "component": pa.array(nodes[up])})


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with a link (a, b: longs). Self links and repeats are allowed;
    an empty table gives no rows. Each round is written to the checkpoint folder; nothing comes to the driver but
    counts and a checksum."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(lean(join_links), "node long, component long")
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
