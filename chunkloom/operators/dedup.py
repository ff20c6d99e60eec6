"""Exact de-duplication by fingerprint, recipes and restore. Chunks are ordered by (version_no, file_id, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["version_no", "file_id", "seq"]


def place() -> Column:
    return F.struct(*PLACE)


def fingerprinted(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("fp", F.sha2("payload", 256))


def first_occurrences(chunks: DataFrame, *of_bytes: str) -> DataFrame:
    """fp, first (place), copies, chunk_size, and the columns named, which follow from the chunk's bytes. One aggregation
    with partial sums on the map side; no payload moves."""
    return chunks.groupBy("fp").agg(F.min(place()).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("chunk_size", *of_bytes)])


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id, fp, version_no, file_id, seq, chunk_size, copies: chunk_id is dense in the order of first places.

    Ids are counted in two levels (within versions and over versions' totals), so no task sees all chunks."""
    return numbered(first_occurrences(chunks).select("fp", "first.*", "copies", "chunk_size"))


def numbered(first: DataFrame) -> DataFrame:
    """Unique chunks with their chunk_id."""
    per = first.groupBy("version_no", "file_id").agg(F.count("*").alias("_n"))
    # within a version over its files, then over versions: both tables are far smaller than the chunks
    in_version = per.withColumn("_f", F.sum("_n").over(Window.partitionBy("version_no").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)))
    totals = per.groupBy("version_no").agg(F.sum("_n").alias("_t")).withColumn("_v", F.sum("_t").over(Window.orderBy("version_no").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = in_version.join(totals, "version_no").select("version_no", "file_id", (F.coalesce("_f", F.lit(0)) + F.coalesce("_v", F.lit(0))).alias("_off"))
    nth = F.row_number().over(Window.partitionBy("version_no", "file_id").orderBy("seq")) - 1
    return first.join(offsets, ["version_no", "file_id"]).withColumn("chunk_id", (F.col("_off") + nth).cast("long")).drop("_off")


def duplicates(chunks: DataFrame) -> DataFrame:
    """Every occurrence that is not the first, with the first one's place."""
    first = first_occurrences(chunks).where("copies > 1").select("fp", "first")
    return chunks.join(first, "fp").where(place() != F.col("first")).select("fp", *PLACE, F.col("first.version_no").alias("first_version"), F.col("first.file_id").alias("first_file"), F.col("first.seq").alias("first_seq"))


def recipes(chunks: DataFrame, unique: DataFrame) -> DataFrame:
    """version_no, file_id, seq, chunk_id for every logical chunk; of archives (chunks with a kind) also part, header or
    data: an archive has a recipe for each."""
    part = [F.when(F.col("kind") == "header", "header").otherwise("data").alias("part")] if "kind" in chunks.columns else []
    return chunks.select("fp", *PLACE, *part).join(unique.select("fp", "chunk_id"), "fp").drop("fp")


def restore(recipe: DataFrame, payloads: DataFrame, keys: tuple[str, ...] = ("version_no", "file_id")) -> DataFrame:
    """version_no, file_id, content: the payloads (chunk_id, payload) of each file's recipe in order, joined by one pass
    over sorted rows. A file is one row and so below 2 GB; restore_pieces() has no such limit."""
    rows = recipe.join(payloads.select("chunk_id", "payload"), "chunk_id").select(*keys, "seq", "payload")
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types, strict=True)), pa.array([b"".join(held)], pa.binary())], [*keys, "content"])

        types = None
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            for *now, data in zip(*(b.column(c).to_pylist() for c in (*keys, "payload")), strict=True):
                if now != key:
                    if held:
                        yield one()
                    key, held = now, []
                held.append(data or b"")
        if held:
            yield one()

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "seq")
    return ordered.mapInArrow(run, ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + ", content binary")


def restore_pieces(recipe: DataFrame, payloads: DataFrame, size: int = 64 << 20) -> DataFrame:
    """version_no, file_id, piece, content: as restore(), in pieces of about `size` bytes that can be written one after
    the other; a piece holds whole chunks."""
    places = recipe.join(payloads.select("chunk_id", F.octet_length("payload").alias("n")), "chunk_id")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("version_no", "file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = places.withColumn("piece", F.floor(before / size)).select(*PLACE, "chunk_id", "piece")
    return restore(numbered, payloads, ("version_no", "file_id", "piece"))


def version_log(chunks: DataFrame) -> DataFrame:
    """Per version: logical and newly stored chunks and bytes, running totals, and the running dedup ratio."""
    first = F.min("version_no").over(Window.partitionBy("fp"))
    # one row for each fingerprint and version before any window
    per = chunks.groupBy("fp", "version_no").agg(F.count("*").alias("n"), F.sum("chunk_size").alias("bytes"), F.first("chunk_size").alias("size"))
    per = per.withColumn("new", F.col("version_no") == first)
    v = per.groupBy("version_no").agg(
        F.sum("n").alias("logical_chunks"), F.sum("bytes").alias("logical_bytes"),
        F.sum(F.when(F.col("new"), 1).otherwise(0)).alias("new_chunks"), F.sum(F.when(F.col("new"), F.col("size")).otherwise(0)).alias("new_bytes"),
    )
    so_far = Window.orderBy("version_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.withColumn("total_logical", F.sum("logical_bytes").over(so_far)).withColumn("total_stored", F.sum("new_bytes").over(so_far))
    return v.withColumn("ratio", F.col("total_logical") / F.col("total_stored"))
