"""Reduction metrics over decisions (chunk_id, kind, chunk_size, save_size, is_header) and logical totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES, DELTAS = ("BASE_LZ4", "BASE_RAW"), ("DELTA", "FEATURE_DELTA", "LOCAL_DELTA")
#: What deltas of a cause save; other deltas are in delta_reduct only.
CAUSES = {"feature_reduct": "FEATURE_DELTA", "locality_reduct": "LOCAL_DELTA"}
#: Bytes of the index model for each unique chunk, base chunk and recipe entry.
FP_BYTES, BASE_BYTES, RECIPE_BYTES = 80 + 32, 120, 8


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def reduction(decisions: DataFrame, logical: DataFrame) -> DataFrame:
    """One row. logical: one row with logical_chunks and logical_bytes."""
    base, delta = F.col("kind").isin(*BASES), F.col("kind").isin(*DELTAS)
    d = decisions.agg(
        F.count("*").alias("unique_chunks"), F.count_if(base).alias("base_chunks"), F.count_if(delta).alias("delta_chunks"),
        F.coalesce(F.sum("save_size"), F.lit(0)).alias("stored_bytes"),
        F.coalesce(F.sum(F.when(base, F.col("save_size"))), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum(F.when(delta, F.col("save_size"))), F.lit(0)).alias("delta_bytes"),
        F.coalesce(F.sum(F.when(delta, F.col("chunk_size"))), F.lit(0)).alias("delta_original"),
        F.coalesce(F.sum(F.when(base, F.col("chunk_size"))), F.lit(0)).alias("base_original"),
        F.avg(F.when(delta, F.expr("chunk_size div save_size"))).alias("dce"),
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("chunk_size") - F.col("save_size"))), F.lit(0)).alias(n) for n, k in CAUSES.items()],
    )
    both = d.crossJoin(logical)  # one row by one row
    return both.select(
        "logical_chunks", "logical_bytes", "unique_chunks", "base_chunks", "delta_chunks", "stored_bytes", "base_bytes", "delta_bytes",
        _ratio(F.col("logical_bytes"), F.col("stored_bytes")).alias("ocr"), _ratio(F.col("delta_chunks"), F.col("unique_chunks")).alias("dcc"),
        _ratio(F.col("delta_original"), F.col("delta_bytes")).alias("dcr"), "dce",
        (F.col("logical_bytes") - F.col("base_original") - F.col("delta_original")).alias("dedup_reduct"),
        (F.col("base_original") - F.col("base_bytes")).alias("local_reduct"), (F.col("delta_original") - F.col("delta_bytes")).alias("delta_reduct"), *CAUSES,
    )


def cascade(m: DataFrame) -> DataFrame:
    """Ratios after dedup, after lossless coding too, and after deltas too."""
    L, d, loc, dl = (F.col(c) for c in ("logical_bytes", "dedup_reduct", "local_reduct", "delta_reduct"))
    return m.select(_ratio(L, L - d).alias("dedup_ratio"), _ratio(L, L - d - loc).alias("lossless_ratio"), _ratio(L, L - d - loc - dl).alias("delta_ratio"))


def index_overhead(m: DataFrame) -> DataFrame:
    u, b, n = F.col("unique_chunks"), F.col("base_chunks"), F.col("logical_chunks")
    return m.select((u * FP_BYTES).alias("fp_bytes"), (b * BASE_BYTES).alias("sf_bytes"), (n * RECIPE_BYTES).alias("recipe_bytes"), (u * FP_BYTES + b * BASE_BYTES).alias("total_bytes"), (b * 3).alias("sf_number"))


#: Bytes of the locality method's model for each fingerprint, chunk number, base and name, and of the
#: tiered method's for each super-feature stored.
LOCAL_FP_BYTES, LOCAL_ID_BYTES, LOCAL_BASE_BYTES, NAME_BYTES, TIER_BYTES = 40, 72, 48, 12, 40


def locality_overhead(m: DataFrame, names: DataFrame) -> DataFrame:
    """names: one row with names, the size of the name table."""
    u, b, n, k = (F.col(c) for c in ("unique_chunks", "base_chunks", "logical_chunks", "names"))
    fp, ids, sf, table = u * LOCAL_FP_BYTES, u * LOCAL_ID_BYTES, b * LOCAL_BASE_BYTES, k * NAME_BYTES
    return m.crossJoin(names).select(fp.alias("fp_bytes"), ids.alias("id_bytes"), sf.alias("sf_bytes"), table.alias("name_bytes"), (n * RECIPE_BYTES).alias("recipe_bytes"), (fp + ids + sf + table).alias("total_bytes"))  # one row by one row


def tiered_overhead(m: DataFrame, stored: DataFrame) -> DataFrame:
    """stored: one row with sf_number, the super-features that ever had an entry."""
    u, n, k = (F.col(c) for c in ("unique_chunks", "logical_chunks", "sf_number"))
    return m.crossJoin(stored).select((u * FP_BYTES).alias("fp_bytes"), (k * TIER_BYTES).alias("sf_bytes"), (n * RECIPE_BYTES).alias("recipe_bytes"), (u * FP_BYTES + k * TIER_BYTES).alias("total_bytes"), "sf_number")  # one row by one row


def throughput(log: DataFrame) -> DataFrame:
    """version_no, seconds, logical and reduced bytes a second of each version (log: version_no, logical_bytes, new_bytes,
    seconds); null where no time was measured."""
    a_second = lambda x: F.when(F.col("seconds") > 0, x / F.col("seconds"))
    return log.select("version_no", "seconds", a_second(F.col("logical_bytes")).alias("bytes_a_second"), a_second(F.col("logical_bytes") - F.col("new_bytes")).alias("reduced_a_second"))


def by_header(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("is_header", "kind").agg(F.count("*").alias("chunks"), F.sum("chunk_size").alias("logical_bytes"), F.sum("save_size").alias("stored_bytes"))
