"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import jaccard, licenses, mixing, neighbours, quality, rollups, sentencepiece_bpe, substrings, suffixes, tiff
from chunkloom.llm.common import cut, read_table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = sentencepiece_bpe.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_bpe.round_trip(read_table(spark, sf_dir, "documents"), model)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read_table(spark, sf_dir, "documents"))


def op4_substring_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read_table(spark, sf_dir, "documents"))


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media_digests(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def op7_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read_table(spark, sf_dir, "documents"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: all documents under both tokenizers, one of them sent twice; documents without text or with under
    five words leave; the counts under words-1 are revised to leave out words of a single sign."""
    from pyspark.sql import functions as F

    docs = read_table(spark, sf_dir, "documents")
    single = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D](?![^\x20\x09-\x0D])"))
    # each text is counted once; the batches read the counts
    counted = cut(docs.select("source", "lang", *[rollups.token_count(docs["text"], t).alias(t) for t in rollups.TOKENIZERS], single.cast("long").alias("single")))
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rollup-{uuid.uuid4().hex}"
    r = rollups.Rollup(spark, root)
    all_of = lambda df, t, sign=1: rollups.changes(df, t, sign, F.col(t))
    r.commit("words-1", all_of(counted, "words-1"))
    r.commit("words-2", all_of(counted, "words-2"))
    r.commit("words-2", all_of(counted, "words-2"))
    short, stay = counted.where(F.col("words-1") < 5), counted.where(F.col("words-1") >= 5)
    r.commit("short-leave", all_of(short, "words-1", -1), all_of(short, "words-2", -1))
    r.commit("words-1-longer", rollups.revisions(stay, F.col("words-1"), F.col("words-1") - F.col("single"), "words-1"))
    return r.totals()


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"))


_OP8_SQL = r"""
WITH w AS (
  SELECT source, lang, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: true) AS a,
         len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS n2
  FROM documents),
c AS (SELECT source, lang, len(list_filter(a, lambda x: length(x) > 1)) AS n1, n2 FROM w WHERE len(a) >= 5),
u AS (SELECT source, lang, 'words-1' AS tokenizer, n1 AS n FROM c UNION ALL SELECT source, lang, 'words-2', n2 FROM c)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM u GROUP BY ALL
"""

_OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
e AS (SELECT doc_id, a, unnest(generate_series(1, greatest(len(a) - 4, 1))) AS i FROM w WHERE len(a) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(a[i:i + 4], ' ') AS g FROM e),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

_OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
e AS (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM w),
k AS (SELECT doc_id, i, a[i] AS word, CASE WHEN i + 19 <= len(a) THEN array_to_string(a[i:i + 19], ' ') END AS s FROM e),
f AS (SELECT *, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later FROM k),
g AS (SELECT doc_id, i, word, max(CAST(later AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
t AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS h FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(h, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""

_OP7_SQL = r"""
WITH w AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
e AS (SELECT doc_id, b, unnest(generate_series(1, octet_length(b))) AS i FROM w),
k AS (SELECT doc_id, i, hex(b[i:i]) AS x, CASE WHEN i + 99 <= octet_length(b) THEN md5(hex(b[i:i + 99])) END AS s FROM e),
f AS (SELECT *, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later FROM k),
g AS (SELECT doc_id, i, x, max(CAST(later AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
p AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM g),
t AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, sum(CAST(opens AS INT)) AS m, sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (gone = 0), ''))) AS h FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(m, 0) AS BIGINT) AS n_spans, coalesce(h, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_mix_sources, op3_ngram_jaccard_join, op4_substring_fm_index, op5_tiff_media, op6_license_scan, op7_suffix_intervals, op8_token_rollup, op9_quality_classifier, op10_kmeans_tree_search)}

ORACLE_SQL: dict[str, str] = {"op3_ngram_jaccard_join": _OP3_SQL, "op4_substring_fm_index": _OP4_SQL, "op7_suffix_intervals": _OP7_SQL, "op8_token_rollup": _OP8_SQL}
