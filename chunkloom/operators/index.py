"""Index policies as joins: which earlier chunk a probing chunk's super-features find.

Input is long form: sf(chunk_id, pos, sf). A probe walks its positions in order and takes the first that hits. Shared
indexes match a value stored from any position; per-position indexes only its own. Chunks see strictly smaller ids.

A value that very many chunks share (that of chunks without features, say) is not one task's: its rows are looked
through in spans of ids, and what each span leaves to the later ones is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(per_position: bool) -> list[str]:
    return ["sf", "pos"] if per_position else ["sf"]


#: Chunk ids in a span.
SPAN = 1 << 16


def _earlier(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("chunk_id").rangeBetween(Window.unboundedPreceding, -1)


def _before(df: DataFrame, keys: list[str], value: Column, name: str, largest: bool = True) -> DataFrame:
    """df with the largest (smallest) value, one that grows with chunk_id, of the rows of smaller ids and the same keys."""
    pick = F.max if largest else F.min
    rows = df.withColumn("_span", F.expr(f"chunk_id div {SPAN}"))
    spans = rows.groupBy(*keys, "_span").agg(pick(value).alias("_v"))
    upto = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_span", pick("_v").over(upto).alias("_other"))
    own = pick(value).over(_earlier([*keys, "_span"]))
    first, second = (own, F.col("_other")) if largest else (F.col("_other"), own)
    return rows.join(spans, [*keys, "_span"]).withColumn(name, F.coalesce(first, second)).drop("_span", "_other")


def _first_hit(hits: DataFrame) -> DataFrame:
    """chunk_id, base_id, pos of the first position with a hit."""
    return hits.where("base_id is not null").groupBy("chunk_id").agg(F.min(F.struct("pos", "base_id")).alias("m")).select("chunk_id", F.col("m.base_id").alias("base_id"), F.col("m.pos").alias("pos"))


def latest(sf: DataFrame, per_position: bool = False) -> DataFrame:
    return _first_hit(_before(sf, _keys(per_position), F.col("chunk_id"), "base_id"))


def first(sf: DataFrame, per_position: bool = False) -> DataFrame:
    return _first_hit(_before(sf, _keys(per_position), F.col("chunk_id"), "base_id", largest=False))


def _thinned(sf: DataFrame, chosen: Column) -> DataFrame:
    """The insert whose number is `chosen` of the count so far (column n). Values repeated in a chunk count each time."""
    count = F.count("*").over(_earlier(["sf"]))
    nth = F.row_number().over(Window.partitionBy("sf").orderBy("chunk_id", "pos")) - 1
    numbered = sf.withColumn("n", count).withColumn("nth", nth)
    probe = numbered.where("n > 0").select("chunk_id", "pos", "sf", chosen.cast("long").alias("want"))
    stored = numbered.select("sf", F.col("nth").cast("long").alias("want"), F.col("chunk_id").alias("base_id"))
    return _first_hit(probe.join(stored, ["sf", "want"]))


def log2(sf: DataFrame) -> DataFrame:
    """The slot is replaced by inserts number 0, 1, 2, 4, 8, ..."""
    n = F.col("n") - 1
    return _thinned(sf, F.when(n == 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(F.greatest(n, F.lit(1)))) - 1)))


def less4(sf: DataFrame) -> DataFrame:
    """The slot is replaced by the first five inserts."""
    return _thinned(sf, F.least(F.col("n") - 1, F.lit(4)))


def _shared(sf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sf, chunk_id of values that several chunks have, and chunk_id, sf: the first value that an earlier chunk has, too."""
    ends = sf.groupBy("sf").agg(F.min("chunk_id").alias("lead"), F.max("chunk_id").alias("last")).where("lead < last").select("sf", "lead")
    shared = sf.select("chunk_id", "pos", "sf").join(ends, "sf")  # a value that one chunk has alone goes no further
    pos = shared.where("lead < chunk_id").groupBy("chunk_id").agg(F.min(F.struct("pos", "sf")).alias("m")).select("chunk_id", "m.sf")
    return shared.select("sf", "chunk_id").distinct(), pos


def all_matches(sf: DataFrame) -> DataFrame:
    """chunk_id, base_id: every earlier chunk under the first position that hits."""
    stored, pos = _shared(sf)
    return pos.join(stored.withColumnRenamed("chunk_id", "base_id"), "sf").where("base_id < chunk_id").select("chunk_id", "base_id")


def groups(sf: DataFrame) -> DataFrame:
    """sf, chunk_id, target: what all_matches() joins. Chunks of a value are candidates of its later targets, and a chunk is
    a target of one value at most. Rows are dealt by value once."""
    stored, pos = _shared(sf.repartition(int(sf.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sf"))
    return stored.join(pos.withColumn("target", F.lit(True)), ["sf", "chunk_id"], "left").withColumn("target", F.coalesce("target", F.lit(False)))


def tiered(sf: DataFrame, keep: dict[int, int]) -> DataFrame:
    """chunk_id, base_id, tier, pos of tiered super-features (version_no, chunk_id, tier, pos, sf): tiers in order, then
    positions. keep: versions after which a tier's entries expire; an entry lives on while it is stored again."""
    last = _before(sf, ["tier", "sf"], F.struct("chunk_id", "version_no"), "m").where("m is not null")
    alive = F.lit(True)
    for tier, versions in keep.items():
        alive = alive & ~((F.col("tier") == tier) & (F.col("version_no") - F.col("m.version_no") > versions))
    best = F.min(F.struct("tier", "pos", F.col("m.chunk_id").alias("base_id"))).alias("b")
    return last.where(alive).groupBy("chunk_id").agg(best).select("chunk_id", "b.base_id", "b.tier", "b.pos")


def last_of_name(chunks: DataFrame) -> DataFrame:
    """chunk_id, base_id: the latest earlier chunk (chunk_id, name) of the same name; chunks without a name have none."""
    return _before(chunks.where("name is not null"), ["name"], F.col("chunk_id"), "base_id").where("base_id is not null").select("chunk_id", "base_id")


# ---- records with super-features


def upsert(records: DataFrame, changes: DataFrame) -> DataFrame:
    """records (key, pos, sf) after changes of the same shape: a changed key is replaced; a change without sf deletes."""
    return records.join(changes.select("key").distinct(), "key", "left_anti").unionByName(changes.where("sf is not null"))


def similar_records(records: DataFrame) -> DataFrame:
    """key, other: other records that share a super-feature."""
    other = records.select("sf", F.col("key").alias("other")).distinct()
    return records.select("key", "sf").distinct().join(other, "sf").where("key <> other").select("key", "other").distinct()


def count_similar(records: DataFrame) -> DataFrame:
    """One row: how many records share a super-feature with another one."""
    shared = records.select("key", "sf").distinct().groupBy("sf").agg(F.count("*").alias("n")).where("n > 1").select("sf")
    return records.join(shared, "sf", "left_semi").agg(F.countDistinct("key").alias("similar"))
