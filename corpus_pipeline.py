"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents.

Null ids, texts and columns pass through as the operators define; rows that share an id are judged each on its own text;
an empty table stays empty; extra columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import jaccard, mixing, quality, sentencepiece_bpe, substrings
from chunkloom.llm.common import cut, ensure_checkpoint_dir, few_files, read_table, unused


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    return few_files(quality.keep_good(docs, read_table(spark, sf_dir, "labels")))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row with the smallest id; rows without an id or without shingles stay.

    Rows are told apart by id and text, as ids may be repeated; of repeats in both any one stays."""
    (key,) = unused(docs.columns, "row")
    keyed = docs.withColumn(key, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    classes = jaccard.classes(keyed.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0")
    named = classes.groupBy(F.col("doc_id").alias("k"), "component_id").agg(F.count("*").alias("n"))
    ids = keyed.where("doc_id is not null").select(F.col(key).alias("k"), F.col("doc_id").cast("long").alias("id")).distinct()
    named = cut(named.join(ids, "k"))
    first = named.groupBy("component_id").agg(F.min(F.struct("id", "k")).alias("m"))
    decided = cut(named.join(first, "component_id").select(F.col("k").alias(key), (F.col("k") == F.col("m.k")).alias("stays"), "n").where("not stays or n > 1"))
    rest = keyed.join(decided.select(key), key, "left_anti")
    single = keyed.join(decided.where("stays").select(key), key, "left_semi").dropDuplicates([key])
    return few_files(rest.unionByName(single).select(*docs.columns))


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that start earlier too; n_chars follows the text."""
    return few_files(substrings.cleaned(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Rows are told apart by id, text and source; of rows equal in these,
    which the mix may take a different number of times, each comes as often as the one taken most."""
    key, source, copies, nth = unused(docs.columns, "name", "mixed", "copies", "copy")
    taken = mixing.mix(docs).where("copies > 0").groupBy(F.col("name").alias(key), F.col("source").alias(source)).agg(F.max("copies").cast("int").alias(copies))
    named = docs.withColumn(nth, mixing.row_name(docs))
    both = named.join(taken, (named[nth] == taken[key]) & named["source"].cast("string").eqNullSafe(taken[source]))
    return few_files(both.select(*docs.columns, F.explode(F.sequence(F.lit(1), copies)).alias(nth)).select(*docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, is_lossless of every document that the mix holds, in its copies."""
    import public_tokenizers

    model = sentencepiece_bpe.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    return few_files(sentencepiece_bpe.encode_corpus(docs, model))


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_near_duplicates),
    ("substring dedup", remove_substrings),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: No SQL can express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages return is kept in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
