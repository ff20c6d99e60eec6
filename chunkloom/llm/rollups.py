"""Token counts kept by deltas: signed inserts, deletes and revised counts update additive totals.

A rollup is a folder with one Parquet folder per batch, each holding the batch's summed signed deltas by
(source, lang, tokenizer). A batch folder is committed when Spark has written its _SUCCESS file; committing a batch
name again changes nothing, and a batch that failed half-way is written anew. Totals are the sum over committed
batches, so their order does not matter; compact() replaces old batches by one that remembers their names, and the
names that compactions among them remember, however often that is repeated.

Defined results: null source or lang form groups of their own; null texts count 0 tokens and 1 document; repeated
rows count each time; extra columns are ignored; empty batches commit and add nothing; a group whose documents and
tokens are both zero is left out of totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
COMPACTED = "compacted-"
#: Tokenizer versions that SQL can express: runs of non-blanks, and runs of letters, digits and non-ASCII signs.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def token_count(text: Column, tokenizer: str) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKENIZERS[tokenizer])).cast("long")


def changes(docs: DataFrame, tokenizer: str, sign: int = 1, tokens: Column | None = None) -> DataFrame:
    """Signed changes that insert (1) or delete (-1) documents: source, lang, tokenizer, n_docs, n_tokens. tokens: a
    column with the count, where it is known; else the text is counted."""
    n = token_count(docs["text"], tokenizer) if tokens is None else tokens.cast("long")
    return docs.select(
        docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("long").alias("n_docs"), (F.lit(sign) * n).alias("n_tokens"),
    )


def revisions(df: DataFrame, old: Column, new: Column, tokenizer: str) -> DataFrame:
    """Changes for documents that stay and whose count is revised from old to new."""
    return df.select(
        df["source"].cast("string").alias("source"), df["lang"].cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"),
        F.lit(0).cast("long").alias("n_docs"), (new - old).cast("long").alias("n_tokens"),
    )


class Rollup:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _folder(self, batch: str) -> str:
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch name has letters, digits, - and _")
        return f"{self.root}/batch={batch}"

    def _committed(self) -> set[str]:
        """Names of batches whose folder is there and complete."""
        if not self._fs.exists(self._path(self.root)):
            return set()
        found = [s.getPath().toString() for s in self._fs.listStatus(self._path(self.root))]
        return {p.rpartition("batch=")[2] for p in found if "batch=" in p and self._fs.exists(self._path(f"{p}/_SUCCESS"))}

    def _replaced(self, committed: set[str]) -> set[str]:
        """Names that committed compactions stand for."""
        out = set()
        for n in committed:
            if n.startswith(COMPACTED):
                out |= {r["name"] for r in self.spark.read.parquet(f"{self.root}/names-{n}").collect()}
        return out

    def batches(self) -> list[str]:
        """Names of committed batches, those that were compacted away included."""
        committed = self._committed()
        return sorted(committed | self._replaced(committed))

    def commit(self, batch: str, *deltas: DataFrame) -> bool:
        """Adds the batch once; False if it was there already."""
        if batch.startswith(COMPACTED):
            raise ValueError(f"names that begin with {COMPACTED} are those of compactions")
        if batch in self.batches():
            return False
        whole = deltas[0]
        for d in deltas[1:]:
            whole = whole.unionByName(d)
        summed = whole.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(self._folder(batch))
        return True

    def _live(self) -> list[str]:
        committed = self._committed()
        return sorted(committed - self._replaced(committed))

    def totals(self) -> DataFrame:
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        df = self.spark.read.parquet(*map(self._folder, live))
        return df.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, name: str) -> None:
        """One batch for all live ones; a name that was used changes nothing. The names go first: until the sums are
        committed the old batches count, and from then on they are replaced, whether or not their folders are gone."""
        committed, new = self._committed(), f"{COMPACTED}{name}"
        known = self._replaced(committed)
        live = sorted(committed - known)
        if not live or new in committed | known:
            return
        sums = self.spark.read.parquet(*map(self._folder, live)).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        names = sorted(committed | known)
        self.spark.createDataFrame([(x,) for x in names], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/names-{new}")
        sums.write.mode("overwrite").parquet(self._folder(new))
        for x in sorted(committed):
            self._fs.delete(self._path(self._folder(x)), True)
            if x.startswith(COMPACTED):
                self._fs.delete(self._path(f"{self.root}/names-{x}"), True)
