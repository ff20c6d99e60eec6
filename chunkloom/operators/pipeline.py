"""The whole reduction as one object: segmenter, features, index policy and method in, tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import features as ft
from chunkloom.functions.names import strip_version
from chunkloom.operators import archive, dedup, index, metrics, reduce, segment, store
from chunkloom.operators.components import cut
from chunkloom.sources import corpus

CHUNKERS = {
    "fixed": lambda f, h: segment.fixed(f), "fastcdc": lambda f, h: segment.content_defined(f), "gearcdc": lambda f, h: segment.content_defined(f, segment.GEARCDC),
    "small_fixed": lambda f, h: segment.fixed(f, 64), "small_fastcdc": lambda f, h: segment.content_defined(f, segment.SMALL_FASTCDC),
    "tar": lambda f, h: archive.tar_segments(f), "tar_headers": lambda f, h: archive.tar_segments(f, h),
    "mtar": lambda f, h: segment.content_defined(archive.rewrite(f)), "mtar_gear": lambda f, h: segment.content_defined(archive.rewrite(f), segment.GEARCDC),
}
POLICIES = {"mibl": index.latest, "log2": index.log2, "less4": index.less4, "all_greedy": index.all_matches}


def super_features(unique: DataFrame, family: str = "odess", gate: int = ft.MIN_SIZE, zeros: bool = True) -> DataFrame:
    """chunk_id, pos, sf of chunks larger than the gate. zeros=False leaves out chunks whose features are all zero."""
    f = {"odess": ft.odess_features, "ntransform": ft.ntransform_features, "finesse": ft.finesse_features}[family]
    s = {"odess": ft.odess_super, "ntransform": ft.ntransform_super, "finesse": ft.finesse_super}[family]
    rows = cut(unique.where(F.col("chunk_size") > gate).select("chunk_id", f("payload").alias("f")))
    if not zeros:
        rows = rows.where(F.exists("f", lambda x: x != 0))
    out = rows.select("chunk_id", F.posexplode(s(F.col("f"))).alias("pos", "sf"))
    return out.withColumn("sf", F.xxhash64("sf")) if family == "finesse" else out


def _tiers(unique: DataFrame) -> DataFrame:
    """chunk_id, pos, sf: a position is ten times the tier and its number there."""
    rows = cut(unique.select("chunk_id", ft.odess_features("payload").alias("f")))
    return rows.select("chunk_id", F.explode(ft.tiered_super(F.col("f"))).alias("t")).select("chunk_id", (F.col("t.tier") * 10 + F.col("t.pos")).alias("pos"), "t.sf")


@dataclass
class ReductionPipeline:
    chunker: str = "fastcdc"
    method: str = "tree_cut"
    gate: int = ft.MIN_SIZE
    versions: int | None = None  # only so many
    headers: int = 16  # in a header chunk of "tar_headers"
    threshold: float | None = None  # of the locality method, in place of its estimate of gains
    locality: bool = True  # whether that method looks at names at all

    def run(self, files: DataFrame) -> dict[str, DataFrame]:
        """chunks, unique, recipes, decisions, containers, metrics."""
        files = files if self.versions is None else corpus.first_versions(files, self.versions)
        chunks = cut(dedup.fingerprinted(CHUNKERS[self.chunker](files, self.headers)))
        unique = dedup.unique_chunks(chunks)
        carried = ["payload"]
        if "name" in chunks.columns:  # of archives: headers and bodies of a member apart
            carried.append(F.concat_ws("/", F.when(F.col("kind") == "header", "header").otherwise("body"), strip_version(F.col("name"))).alias("member"))
        unique = cut(unique.join(chunks.select(*dedup.PLACE, *carried), dedup.PLACE))
        return {"chunks": chunks, "unique": unique, "recipes": dedup.recipes(chunks, unique)} | self.decide(chunks, unique)

    def decide(self, chunks: DataFrame, unique: DataFrame) -> dict[str, DataFrame]:
        m = self.method
        if m == "dedup":
            decisions = reduce.by_candidates(unique, unique.sparkSession.createDataFrame([], "chunk_id long, base_id long"))
        elif m in POLICIES:
            sf = super_features(unique, gate=self.gate)
            decisions = reduce.by_all(unique, sf) if m == "all_greedy" else reduce.by_candidates(unique, POLICIES[m](sf))
        else:
            family = m if m in ("ntransform", "finesse") else "odess"
            sf = _tiers(unique) if m == "palantir" else super_features(unique, family, -1 if m in ("ntransform", "finesse", "bisearch") else self.gate)
            repeats = names = None
            if m == "palantir":
                known = unique.select("fp", "chunk_id", dedup.place().alias("first"))
                repeats = chunks.select("fp", *dedup.PLACE).join(known, "fp").where(dedup.place() != F.col("first"))
            if m == "bisearch" and self.locality:  # a file without members is its own
                names = unique.select("chunk_id", (F.col("member") if "member" in unique.columns else F.col("file_id").cast("string")).alias("name"))
            samples = unique.select("chunk_id", ft.sampled_features("payload").alias("s")) if m == "mibl3" else None
            decisions = reduce.replay(unique, sf, m, samples, repeats, names, self.threshold)
        decisions = cut(decisions)
        placed = store.pack(decisions.join(unique.select("chunk_id", "version_no"), "chunk_id").withColumnRenamed("save_size", "stored"))
        logical = chunks.agg(F.count("*").alias("logical_chunks"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("logical_bytes"))
        return {"decisions": decisions, "containers": placed, "metrics": metrics.reduction(decisions, logical)}
