"""Named queries over the driver's tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions import features as ft
from chunkloom.functions import names
from chunkloom.operators import archive, codec, dedup, index, metrics, reduce, segment, store
from chunkloom.operators.components import cut
from chunkloom.operators.pipeline import ReductionPipeline, super_features
from chunkloom.plans import sql
from chunkloom.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SIZE = 64

#: Bytes of the fixed chunks of queries that compare all chunks of a value: large enough that few are without features.
WIDE = 512

_V, _K = sql.FILES, sql.fixed(SIZE)
_U = sql.unique(_K)
_W = sql.super_features(sql.unique(sql.fixed(WIDE)))
_S, _D = sql.super_features(sql.SMALL), sql.DECISIONS


def register(name: str, check: str | None = None):
    def deco(f):
        QUERIES[name] = f
        if check is not None:
            ORACLE_SQL[name] = check
        return f

    return deco


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", "doc_id", "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.fingerprinted(segment.fixed(files(spark, sf_dir), SIZE))


def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique chunks with payloads; cut, as several parts of a query read them."""
    c = chunks(spark, sf_dir)
    return cut(dedup.unique_chunks(c.drop("payload")).join(c.select(*dedup.PLACE, "payload"), dedup.PLACE))


def wide_unique(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Unique fixed chunks of WIDE bytes."""
    c = dedup.fingerprinted(segment.fixed(files(spark, sf_dir) if source is None else source, WIDE))
    return cut(dedup.unique_chunks(c.drop("payload")).join(c.select(*dedup.PLACE, "payload"), dedup.PLACE))


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, pos, sf of the unique fixed chunks of WIDE bytes; their super-features move, their bytes do not."""
    c = segment.fixed(files(spark, sf_dir), WIDE).select(*dedup.PLACE, "chunk_size", F.unhex(F.sha2("payload", 256)).alias("fp"), ft.odess_features("payload").alias("f"))
    c = c.withColumn("s", ft.odess_super(F.col("f"))).select(*dedup.PLACE, "chunk_size", "fp", *[F.col("s")[i].alias(f"s{i}") for i in range(3)])
    first = cut(dedup.first_occurrences(c, "s0", "s1", "s2").select("first.*", "chunk_size", "s0", "s1", "s2"))
    rows = dedup.numbered(first).where(F.col("chunk_size") > ft.MIN_SIZE)
    return cut(rows.select("chunk_id", F.posexplode(F.array("s0", "s1", "s2")).alias("pos", "sf")))


def pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Web pages as files, hosts as versions; file_id, name: the address behind the host, without its last part."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", F.split_part("url", F.lit("/"), F.lit(3)))
    member = F.regexp_replace(F.regexp_replace("url", "^[^:]*://[^/]*/", ""), "/?[^/]*$", "")
    return corpus.from_table(p, "host", "page_id", "html"), p.select(F.col("page_id").alias("file_id"), member.alias("name"))


def block_decisions(u: DataFrame) -> DataFrame:
    """Decisions by the latest match of the Odess features, sized by the block codec, which SQL can express, too."""
    base = u.select(F.col("chunk_id").alias("base_id"), F.col("payload").alias("base"))
    m = index.latest(super_features(u)).select("chunk_id", "base_id").join(base, "base_id")
    d = u.join(m, "chunk_id", "left").withColumn("delta", codec.block_delta_size(F.col("payload"), F.col("base")))
    ok = F.coalesce(F.col("delta") <= F.col("chunk_size"), F.lit(False))
    return d.select(
        "chunk_id", "version_no", "chunk_size", (F.col("seq") == 0).alias("is_header"), F.when(ok, F.col("base_id")).alias("base_id"), F.when(ok, "DELTA").otherwise("BASE_RAW").alias("kind"),
        F.when(ok, F.col("delta")).otherwise(F.col("chunk_size")).cast("long").alias("save_size"),
    )


def small_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All and the unique content-defined chunks of the small profile."""
    c = cut(dedup.fingerprinted(segment.content_defined(files(spark, sf_dir), segment.SMALL_FASTCDC)))
    return c, cut(dedup.unique_chunks(c.drop("payload")).join(c.select(*dedup.PLACE, "payload"), dedup.PLACE))


def small_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_chunks(spark, sf_dir)[1]


# ---- sources


@register("files_natural_order", f"WITH {_V} SELECT CAST(version_no AS BIGINT) AS version_no, path, count(*) AS files, CAST(sum(octet_length(b)) AS BIGINT) AS bytes FROM f GROUP BY ALL")
def files_natural_order(spark, sf_dir):
    return files(spark, sf_dir).groupBy(F.col("version_no").cast("long").alias("version_no"), "path").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("bytes"))


@register("first_n_versions", f"WITH {_V} SELECT CAST(version_no AS BIGINT) AS version_no, file_id, CAST(octet_length(b) AS BIGINT) AS bytes FROM f WHERE version_no < 5")
def first_n_versions(spark, sf_dir):
    return corpus.first_versions(files(spark, sf_dir), 5).select(F.col("version_no").cast("long").alias("version_no"), "file_id", F.length("content").cast("long").alias("bytes"))


# ---- segmenters and exact dedup


@register("fixed_chunks", f"WITH {_K} SELECT file_id, CAST(seq AS BIGINT) AS seq, CAST(off AS BIGINT) AS \"offset\", CAST(chunk_size AS BIGINT) AS chunk_size, fp FROM k")
def fixed_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("file_id", "seq", "offset", "chunk_size", "fp")


@register("fixed_chunk_dedup_summary", f"WITH {_K} SELECT version_no, count(*) AS chunks, count(DISTINCT fp) AS distinct_chunks, CAST(sum(chunk_size) AS BIGINT) AS bytes FROM k GROUP BY version_no")
def fixed_chunk_dedup_summary(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy(F.col("version_no").cast("long").alias("version_no")).agg(F.count("*").alias("chunks"), F.countDistinct("fp").alias("distinct_chunks"), F.sum("chunk_size").alias("bytes"))


@register("fixed_chunk_first_occurrence", f"WITH {_U} SELECT fp, version_no, file_id, CAST(seq AS BIGINT) AS seq, copies, CAST(chunk_size AS BIGINT) AS chunk_size FROM u")
def fixed_chunk_first_occurrence(spark, sf_dir):
    return dedup.first_occurrences(chunks(spark, sf_dir)).select("fp", F.col("first.version_no").cast("long").alias("version_no"), "first.file_id", "first.seq", "copies", "chunk_size")


@register("unique_chunk_ids", f"WITH {_U} SELECT chunk_id, fp, file_id, CAST(seq AS BIGINT) AS seq FROM u")
def unique_chunk_ids(spark, sf_dir):
    return dedup.unique_chunks(chunks(spark, sf_dir)).select("chunk_id", "fp", "file_id", "seq")


@register("duplicate_chunks", f"WITH {_U} SELECT o.fp, o.version_no, o.file_id, CAST(o.seq AS BIGINT) AS seq, u.version_no AS first_version, u.file_id AS first_file, CAST(u.seq AS BIGINT) AS first_seq FROM o JOIN u USING (fp) WHERE o.nth > 1")
def duplicate_chunks(spark, sf_dir):
    d = dedup.duplicates(chunks(spark, sf_dir))
    return d.withColumn("version_no", F.col("version_no").cast("long")).withColumn("first_version", F.col("first_version").cast("long"))


@register("recipes_ordered", f"WITH {_U}, r AS (SELECT o.file_id, o.seq, u.chunk_id FROM o JOIN u USING (fp)) SELECT file_id, count(*) AS chunks, md5(string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY seq)) AS recipe FROM r GROUP BY file_id")
def recipes_ordered(spark, sf_dir):
    c = chunks(spark, sf_dir).drop("payload")
    r = dedup.recipes(c, dedup.unique_chunks(c))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"].cast("string"))
    return r.groupBy("file_id").agg(F.count("*").alias("chunks"), F.md5(F.array_join(ids, ",")).alias("recipe"))


def _restored(spark, sf_dir):
    u = unique(spark, sf_dir)
    return dedup.restore(dedup.recipes(chunks(spark, sf_dir), u), u.select("chunk_id", "payload"))


@register("restore_digest", "SELECT doc_id AS file_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS digest FROM documents WHERE text <> ''")
def restore_digest(spark, sf_dir):
    return _restored(spark, sf_dir).select("file_id", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


@register("restore_mismatches", "SELECT doc_id AS file_id FROM documents WHERE false")
def restore_mismatches(spark, sf_dir):
    want = files(spark, sf_dir).where(F.length("content") > 0).select("file_id", F.sha2("content", 256).alias("want"))
    got = _restored(spark, sf_dir).select("file_id", F.sha2("content", 256).alias("got"))
    return want.join(got, "file_id", "full").where(~F.col("want").eqNullSafe(F.col("got"))).select("file_id")


_LOG = f"""{_U}, g AS (SELECT version_no, count(*) AS logical_chunks, sum(chunk_size) AS lb, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) AS nc, sum(CASE WHEN nth = 1 THEN chunk_size ELSE 0 END) AS nb FROM o GROUP BY version_no),
t AS (SELECT *, sum(lb) OVER (ORDER BY version_no) AS tl, sum(nb) OVER (ORDER BY version_no) AS ts FROM g)"""


@register("dedup_by_version_cumulative", f"WITH {_LOG} SELECT version_no, logical_chunks, CAST(lb AS BIGINT) AS logical_bytes, CAST(nc AS BIGINT) AS new_chunks, CAST(nb AS BIGINT) AS new_bytes, CAST(tl AS BIGINT) AS total_logical, CAST(ts AS BIGINT) AS total_stored, CAST(tl AS DOUBLE) / CAST(ts AS DOUBLE) AS ratio FROM t")
def dedup_by_version_cumulative(spark, sf_dir):
    return dedup.version_log(chunks(spark, sf_dir)).withColumn("version_no", F.col("version_no").cast("long"))


@register("version_delta_log", f"WITH {_LOG} SELECT version_no, CAST(lb - lag(lb, 1, 0) OVER (ORDER BY version_no) AS BIGINT) AS logical_change, CAST(lb - nb AS BIGINT) AS reduced FROM t")
def version_delta_log(spark, sf_dir):
    log = dedup.version_log(chunks(spark, sf_dir))
    w = F.lag("logical_bytes", 1, 0).over(Window.orderBy("version_no"))
    return log.select(F.col("version_no").cast("long").alias("version_no"), (F.col("logical_bytes") - w).alias("logical_change"), (F.col("logical_bytes") - F.col("new_bytes")).alias("reduced"))


@register("cross_source_shared_chunks", f"WITH {_K}, g AS (SELECT fp, count(DISTINCT version_no) AS versions, count(*) AS n FROM k GROUP BY fp) SELECT versions, count(*) AS fingerprints, CAST(sum(n) AS BIGINT) AS chunks FROM g GROUP BY versions")
def cross_source_shared_chunks(spark, sf_dir):
    g = chunks(spark, sf_dir).groupBy("fp", "version_no").agg(F.count("*").alias("n")).groupBy("fp").agg(F.count("*").alias("versions"), F.sum("n").alias("n"))
    return g.groupBy("versions").agg(F.count("*").alias("fingerprints"), F.sum("n").alias("chunks"))


@register("header_kind_breakdown", f"WITH RECURSIVE {_D} SELECT is_header, kind, count(*) AS chunks, CAST(sum(chunk_size) AS BIGINT) AS logical_bytes, CAST(sum(save_size) AS BIGINT) AS stored_bytes FROM d GROUP BY is_header, kind")
def header_kind_breakdown(spark, sf_dir):
    return metrics.by_header(block_decisions(small_unique(spark, sf_dir)))


@register("fastcdc_reassembly", "SELECT doc_id AS file_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS digest FROM documents WHERE text <> ''")
def fastcdc_reassembly(spark, sf_dir):
    c = segment.content_defined(files(spark, sf_dir), segment.SMALL_FASTCDC)
    return dedup.restore(c.withColumn("chunk_id", F.col("seq")).select(*dedup.PLACE, "payload", F.struct("file_id", "seq").alias("chunk_id")).drop("payload"), c.select(F.struct("file_id", "seq").alias("chunk_id"), "payload")).select("file_id", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


_CUTS = 'WITH RECURSIVE {} SELECT file_id, seq, CAST(begin AS BIGINT) AS "offset", CAST(cut - begin AS BIGINT) AS chunk_size FROM cuts'


@register("fastcdc_cuts", _CUTS.format(sql.SMALL))
def fastcdc_cuts(spark, sf_dir):
    return segment.content_defined(files(spark, sf_dir), segment.SMALL_FASTCDC).select("file_id", "seq", "offset", "chunk_size")


@register("gear_cuts", _CUTS.format(sql.SMALL_GEAR))
def gear_cuts(spark, sf_dir):
    return segment.content_defined(files(spark, sf_dir), segment.SMALL_GEARCDC).select("file_id", "seq", "offset", "chunk_size")


_TAR = f"""WITH {_V}, a AS (SELECT file_id, path || '/' || file_id AS name, (octet_length(b) + 511) // 512 * 512 AS body FROM f),
t AS (SELECT *, 1 + ((512 + body + 1024 + 10239) // 10240 * 10240 - 512 - body) // 512 AS heads FROM a),
r AS (SELECT file_id, 0 AS seq, 'body' AS kind, 512 AS p, body AS chunk_size, name FROM t WHERE body > 0
  UNION ALL SELECT file_id, j + CASE WHEN body > 0 THEN 1 ELSE 0 END, 'header', CASE WHEN j = 0 THEN 0 ELSE 512 + body + (16 * j - 1) * 512 END, 512 * least(16, heads - 16 * j), CASE WHEN j = 0 THEN name ELSE '' END
    FROM (SELECT *, unnest(range(0, (heads + 15) // 16)) AS j FROM t))
SELECT file_id, CAST(seq AS BIGINT) AS seq, kind, CAST(p AS BIGINT) AS "offset", CAST(chunk_size AS BIGINT) AS chunk_size, name FROM r"""


@register("tar_segments", _TAR)
def tar_segments(spark, sf_dir):
    """Every document as a member of an archive of its own, cut into headers and bodies."""
    import io
    import tarfile

    @F.pandas_udf("binary")
    def tarred(name, text):
        def one(n, t):
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
                info = tarfile.TarInfo(n)
                info.size = len(bytes(t))
                tar.addfile(info, io.BytesIO(bytes(t)))
            return out.getvalue()

        return name.combine(text, one)

    f = files(spark, sf_dir).withColumn("content", tarred(F.concat(F.lit("v/"), F.col("path"), F.lit("/"), F.col("file_id").cast("string")), "content"))
    return archive.tar_segments(f, 16).select("file_id", "seq", "kind", "offset", "chunk_size", names.strip_version(F.col("name")).alias("name"))


# ---- names

_PATH = "split_part(url, '://', 2)"


def _paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace(F.split_part("url", F.lit("://"), F.lit(2)), "\\s", "").alias("name"))


@register("path_strip_version", f"SELECT page_id, regexp_replace(regexp_replace({_PATH}, '\\s', '', 'g'), '^[^/]*/', '') AS member FROM pages")
def path_strip_version(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", names.strip_version(F.col("name")).alias("member"))


@register("path_directory", f"""WITH p AS (SELECT page_id, string_split(regexp_replace({_PATH}, '\\s', '', 'g'), '/') AS a FROM pages)
SELECT page_id, CASE WHEN len(a) >= 2 THEN '/' || array_to_string(CASE WHEN len(a) - 1 >= 4 THEN a[2:len(a) - 2] ELSE a[2:len(a) - 1] END, '/') END AS directory FROM p""")  # fmt: skip
def path_directory(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", names.directory_path(F.col("name")).alias("directory"))


@register("name_hash_equality_groups", f"""SELECT h AS name_hash, count(*) AS n FROM (SELECT CAST(list_reduce(list_prepend(0::UHUGEINT, list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b[i:i]))::UHUGEINT)),
  lambda x, y: (x * {names.NAME_PRIME}::UHUGEINT + y) % 18446744073709551616::UHUGEINT) AS VARCHAR) AS h FROM (SELECT encode(regexp_replace({_PATH}, '\\s', '', 'g')) AS b FROM pages)) GROUP BY h""")  # fmt: skip
def name_hash_equality_groups(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(names.name_hash("name").alias("name_hash")).agg(F.count("*").alias("n"))


# ---- features


def _text(f: str):
    """An array of numbers as text, which both sides write alike."""
    return F.array_join(F.transform(f, lambda x: x.cast("string")), ",").alias("features")


_ODESS = sql.odess(sql.SMALL)
#: Only equality of super-features matters: each is named by the first chunk that has it in any position.
_LEADER = "min(chunk_id) OVER (PARTITION BY sf)"


def _named(sf: DataFrame) -> DataFrame:
    return sf.join(sf.groupBy("sf").agg(F.min("chunk_id").alias("leader")), "sf").drop("sf")


@register("odess_features", f"WITH RECURSIVE {_ODESS} SELECT chunk_id, {sql.FEATURES} AS features FROM fe WHERE chunk_size > {ft.MIN_SIZE}")
def odess_features(spark, sf_dir):
    u = small_unique(spark, sf_dir)
    return u.where(F.col("chunk_size") > ft.MIN_SIZE).select("chunk_id", ft.odess_features("payload").alias("f")).select("chunk_id", _text("f"))


@register("odess_sampled_positions", f"WITH RECURSIVE {_ODESS} SELECT chunk_id, CAST(sampled AS INT) AS sampled FROM fe")
def odess_sampled_positions(spark, sf_dir):
    return small_unique(spark, sf_dir).select("chunk_id", F.size(ft.sampled_features("payload")).alias("sampled"))


@register("odess_super_features", f"WITH RECURSIVE {_S} SELECT chunk_id, pos, {_LEADER} AS leader FROM s")
def odess_super_features(spark, sf_dir):
    return _named(super_features(small_unique(spark, sf_dir)))


def _tiered(u: DataFrame) -> DataFrame:
    rows = u.select("chunk_id", "version_no", ft.odess_features("payload").alias("f"))
    return rows.select("chunk_id", "version_no", F.explode(ft.tiered_super(F.col("f"))).alias("t")).select("chunk_id", "version_no", "t.tier", "t.pos", "t.sf")


@register("tiered_super_features", f"WITH RECURSIVE {sql.tiered(sql.SMALL)} SELECT chunk_id, tier, pos, min(chunk_id) OVER (PARTITION BY tier, sf) AS leader FROM t")
def tiered_super_features(spark, sf_dir):
    return _named(_tiered(small_unique(spark, sf_dir)).drop("version_no"))


@register("finesse_features", f"WITH RECURSIVE {sql.finesse(sql.SMALL)} SELECT chunk_id, {sql.FEATURES} AS features FROM fe")
def finesse_features(spark, sf_dir):
    return small_unique(spark, sf_dir).select("chunk_id", ft.finesse_features("payload").alias("f")).select("chunk_id", _text("f"))


@register("finesse_super_features", f"WITH RECURSIVE {sql.finesse(sql.SMALL)} SELECT chunk_id, pos, {_LEADER} AS leader FROM s")
def finesse_super_features(spark, sf_dir):
    return _named(super_features(small_unique(spark, sf_dir), "finesse", -1))


@register("finesse_latest_match", f"""WITH RECURSIVE {sql.finesse(sql.SMALL)}, h AS (SELECT chunk_id, pos, max(chunk_id) OVER (PARTITION BY sf, pos ORDER BY chunk_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_id FROM s)
SELECT chunk_id, arg_min(base_id, pos) AS base_id, CAST(min(pos) AS BIGINT) AS pos FROM h WHERE base_id IS NOT NULL GROUP BY chunk_id""")  # fmt: skip
def finesse_latest_match(spark, sf_dir):
    return index.latest(super_features(small_unique(spark, sf_dir), "finesse", -1), per_position=True).withColumn("pos", F.col("pos").cast("long"))


@register("ntransform_features", f"WITH RECURSIVE {sql.ntransform(sql.SMALL)} SELECT chunk_id, {sql.FEATURES} AS features FROM fe")
def ntransform_features(spark, sf_dir):
    return small_unique(spark, sf_dir).select("chunk_id", ft.ntransform_features("payload").alias("f")).select("chunk_id", _text("f"))


# ---- index policies

_HIT = "WITH RECURSIVE {s}, h AS ({h}) SELECT chunk_id, arg_min(base_id, pos) AS base_id, CAST(min(pos) AS BIGINT) AS pos FROM h WHERE base_id IS NOT NULL GROUP BY chunk_id"
_FRAME = sql.FRAME
_NTH = f"SELECT *, count(*) {_FRAME} AS n, row_number() OVER (PARTITION BY sf ORDER BY chunk_id, pos) - 1 AS nth FROM s"


def _match(policy, of=lambda *x: super_features(small_unique(*x))):
    def run(spark, sf_dir):
        out = policy(of(spark, sf_dir))
        return out.withColumn("pos", F.col("pos").cast("long")) if "pos" in out.columns else out

    return run


register("sf_latest_match", _HIT.format(s=_S, h=f"SELECT chunk_id, pos, max(chunk_id) {_FRAME} AS base_id FROM s"))(_match(index.latest))
register("sf_first_match", _HIT.format(s=_S, h=f"SELECT chunk_id, pos, min(chunk_id) {_FRAME} AS base_id FROM s"))(_match(index.first))
register("sf_log2_match", _HIT.format(s=f"{_S}, n AS ({_NTH})", h="SELECT p.chunk_id, p.pos, q.chunk_id AS base_id FROM n p JOIN n q ON p.sf = q.sf AND q.nth = CASE WHEN p.n <= 1 THEN 0 ELSE CAST(pow(2, length(bin(p.n - 1)) - 1) AS BIGINT) END WHERE p.n > 0"))(_match(index.log2))
register("sf_less4_match", _HIT.format(s=f"{_S}, n AS ({_NTH})", h="SELECT p.chunk_id, p.pos, q.chunk_id AS base_id FROM n p JOIN n q ON p.sf = q.sf AND q.nth = least(p.n - 1, 4) WHERE p.n > 0"))(_match(index.less4))
register("sf_all_matches", f"""WITH {_W}, h AS (SELECT DISTINCT p.chunk_id, p.pos, q.chunk_id AS base_id FROM s p JOIN s q ON p.sf = q.sf AND q.chunk_id < p.chunk_id),
b AS (SELECT chunk_id, min(pos) AS pos FROM h GROUP BY chunk_id) SELECT DISTINCT h.chunk_id, h.base_id FROM h JOIN b USING (chunk_id, pos)""")(_match(index.all_matches, wide_features))  # fmt: skip

#: After version v the entries of tier 2 older than v - 5 and of tier 3 older than v - 2 go, so the next version still
#: finds those 6 and 3 versions old.
TIER_KEEP = {2: 6, 3: 3}
_TIERS = f"""{sql.tiered(sql.SMALL)},
l AS (SELECT *, max(chunk_id) OVER (PARTITION BY tier, sf ORDER BY chunk_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_id FROM t),
a AS (SELECT l.chunk_id, l.tier, l.pos, l.base_id FROM l JOIN u b ON b.chunk_id = l.base_id WHERE NOT (tier = 2 AND l.version_no - b.version_no > {TIER_KEEP[2]}) AND NOT (tier = 3 AND l.version_no - b.version_no > {TIER_KEEP[3]}))"""


@register("tiered_match_with_expiry", f"WITH RECURSIVE {_TIERS} SELECT chunk_id, arg_min(base_id, tier * 10 + pos) AS base_id, CAST(min(tier * 10 + pos) // 10 AS BIGINT) AS tier, CAST(min(tier * 10 + pos) % 10 AS BIGINT) AS pos FROM a GROUP BY chunk_id")
def tiered_match_with_expiry(spark, sf_dir):
    sf = _tiered(small_unique(spark, sf_dir))
    return index.tiered(sf, TIER_KEEP).select("chunk_id", "base_id", F.col("tier").cast("long").alias("tier"), F.col("pos").cast("long").alias("pos"))


_PAGE_NAMES = f"""{sql.super_features(sql.unique(sql.fixed(WIDE, sql.PAGES)))}, w AS (SELECT page_id AS file_id, {sql.PAGE_NAME} AS name FROM pages),
n AS (SELECT chunk_id, max(chunk_id) OVER (PARTITION BY name ORDER BY chunk_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_id FROM u JOIN w USING (file_id))"""


def _page_names(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Unique chunks of pages, and the latest earlier chunk of each one's name."""
    source, member = pages(spark, sf_dir)
    u = wide_unique(spark, sf_dir, source)
    return u, index.last_of_name(u.join(member, "file_id").select("chunk_id", "name"))


@register("name_table_match", f"WITH {_PAGE_NAMES} SELECT chunk_id, base_id FROM n WHERE base_id IS NOT NULL")
def name_table_match(spark, sf_dir):
    return _page_names(spark, sf_dir)[1]


@register("similar_records", f"WITH {_W} SELECT DISTINCT p.chunk_id AS key, q.chunk_id AS other FROM s p JOIN s q ON p.sf = q.sf AND p.chunk_id <> q.chunk_id")
def similar_records(spark, sf_dir):
    return index.similar_records(super_features(wide_unique(spark, sf_dir)).select(F.col("chunk_id").alias("key"), "pos", "sf"))


@register("similar_record_count", f"WITH RECURSIVE {_S}, g AS (SELECT sf FROM s GROUP BY sf HAVING count(DISTINCT chunk_id) > 1) SELECT count(DISTINCT chunk_id) AS similar FROM s JOIN g USING (sf)")
def similar_record_count(spark, sf_dir):
    return index.count_similar(super_features(small_unique(spark, sf_dir)).select(F.col("chunk_id").alias("key"), "pos", "sf"))


@register("locality_vs_feature", f"""WITH {_PAGE_NAMES}, {sql.LATEST}
SELECT CASE WHEN n.base_id IS NULL AND m.base_id IS NULL THEN 'none' WHEN n.base_id IS NULL THEN 'only_feature' WHEN m.base_id IS NULL THEN 'only_meta' WHEN n.base_id = m.base_id THEN 'same' ELSE 'different' END AS outcome, count(*) AS chunks
FROM u LEFT JOIN n USING (chunk_id) LEFT JOIN m USING (chunk_id) GROUP BY 1""")  # fmt: skip
def locality_vs_feature(spark, sf_dir):
    u, names_ = _page_names(spark, sf_dir)
    n = names_.withColumnRenamed("base_id", "n")
    m = index.latest(super_features(u)).select("chunk_id", F.col("base_id").alias("m"))
    both = u.select("chunk_id").join(n, "chunk_id", "left").join(m, "chunk_id", "left")
    n, m = F.col("n"), F.col("m")
    outcome = F.when(n.isNull() & m.isNull(), "none").when(n.isNull(), "only_feature").when(m.isNull(), "only_meta").when(n == m, "same").otherwise("different")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("chunks"))


# ---- chains, containers, metrics

_EDGES = f"{_S}, h AS (SELECT chunk_id, pos, min(chunk_id) {_FRAME} AS base_id FROM s), e AS (SELECT chunk_id, arg_min(base_id, pos) AS base_id FROM h WHERE base_id IS NOT NULL GROUP BY chunk_id)"
_CHAIN = f"WITH RECURSIVE {_EDGES}, r AS (SELECT chunk_id AS node, base_id AS up, 1 AS depth FROM e UNION ALL SELECT r.node, e.base_id, r.depth + 1 FROM r JOIN e ON e.chunk_id = r.up), x AS (SELECT node, arg_max(up, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM r GROUP BY node)"


def _edges(spark, sf_dir):
    return index.first(super_features(small_unique(spark, sf_dir))).select("chunk_id", "base_id")


@register("ancestor_chain", f"{_CHAIN} SELECT * FROM x")
def ancestor_chain(spark, sf_dir):
    return store.chains(_edges(spark, sf_dir), cut).withColumn("depth", F.col("depth").cast("long"))


@register("subtree_nodes", f"{_CHAIN} SELECT root, count(*) + 1 AS nodes, max(depth) AS deepest FROM x GROUP BY root")
def subtree_nodes(spark, sf_dir):
    return store.subtree_sizes(_edges(spark, sf_dir), cut).withColumn("deepest", F.col("deepest").cast("long"))


@register("container_packing", f"""WITH RECURSIVE {_U}, q AS MATERIALIZED (SELECT chunk_id, chunk_size, sum(chunk_size) OVER (ORDER BY chunk_id) AS upto FROM u),
x AS MATERIALIZED (SELECT q.chunk_id, q.chunk_size, q.upto, n.chunk_id AS after FROM q ASOF LEFT JOIN q n ON n.upto > q.upto - q.chunk_size + 4096),
r AS (SELECT 0 AS container_id, CAST(0 AS BIGINT) AS begins UNION ALL SELECT r.container_id + 1, x.after FROM r JOIN x ON x.chunk_id = r.begins WHERE x.after IS NOT NULL)
SELECT q.chunk_id, CAST(r.container_id AS BIGINT) AS container_id, CAST(q.upto - q.chunk_size - (b.upto - b.chunk_size) AS BIGINT) AS container_offset
FROM q ASOF JOIN r ON q.chunk_id >= r.begins JOIN q b ON b.chunk_id = r.begins""")  # fmt: skip
def container_packing(spark, sf_dir):
    u = dedup.unique_chunks(chunks(spark, sf_dir)).withColumn("stored", F.col("chunk_size"))
    return store.pack(u, 4096, run=2048).select("chunk_id", "container_id", "container_offset")


def _stored(spark, sf_dir, method: str) -> tuple[DataFrame, DataFrame]:
    """Unique chunks, and how the method stores them."""
    c, u = small_chunks(spark, sf_dir)
    return u, cut(store.encode_stored(u, ReductionPipeline("small_fastcdc", method).decide(c, u)["decisions"], grown=method == "midf"))


_NONE = "SELECT doc_id AS chunk_id FROM documents WHERE false"


def _mismatches(method: str):
    def run(spark, sf_dir):
        """Chunks that do not come back from their stored form, down their chains."""
        u, stored = _stored(spark, sf_dir, method)
        back = store.decode_stored(stored, grown=method == "midf").select("chunk_id", F.sha2("payload", 256).alias("got"))
        return u.select("chunk_id", "fp").join(back, "chunk_id", "full").where(~F.col("fp").eqNullSafe(F.col("got"))).select("chunk_id")

    return run


for _name, _method in (("chain_restore_mismatches", "tree_cut"), ("chain_restore_mibl_mismatches", "mibl"), ("chain_restore_midf_mismatches", "midf")):
    register(_name, _NONE)(_mismatches(_method))


@register("chunk_read_digest", f"WITH RECURSIVE {sql.SMALL} SELECT chunk_id, CAST(chunk_size AS BIGINT) AS chunk_size, fp AS digest FROM u WHERE chunk_id % 7 = 3")
def chunk_read_digest(spark, sf_dir):
    """Every seventh chunk, read at random from what the greedy tree method stored."""
    _, stored = _stored(spark, sf_dir, "tree_greedy")
    wanted = stored.where("chunk_id % 7 = 3").select("chunk_id")
    return store.read_chunks(stored, wanted).select("chunk_id", F.octet_length("payload").cast("long").alias("chunk_size"), F.sha2("payload", 256).alias("digest"))


@register("stored_file_digest", "SELECT doc_id AS file_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS digest FROM documents WHERE text <> ''")
def stored_file_digest(spark, sf_dir):
    """Whole files from recipes and what the method with deltas of deltas stored."""
    c, u = small_chunks(spark, sf_dir)
    stored = cut(store.encode_stored(u, ReductionPipeline("small_fastcdc", "tree_cut").decide(c, u)["decisions"]))
    back = dedup.restore(dedup.recipes(c, u), store.decode_stored(stored))
    return back.select("file_id", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


_METRICS = f"""{_D}, lo AS (SELECT count(*) AS lc, sum(chunk_size) AS lb FROM k),
a AS (SELECT lc AS logical_chunks, CAST(lb AS BIGINT) AS logical_bytes, count(*) AS unique_chunks, count(*) FILTER (kind <> 'DELTA') AS base_chunks, count(*) FILTER (kind = 'DELTA') AS delta_chunks,
  CAST(sum(save_size) AS BIGINT) AS stored_bytes, CAST(coalesce(sum(save_size) FILTER (kind <> 'DELTA'), 0) AS BIGINT) AS base_bytes, CAST(coalesce(sum(save_size) FILTER (kind = 'DELTA'), 0) AS BIGINT) AS delta_bytes,
  CAST(coalesce(sum(chunk_size) FILTER (kind = 'DELTA'), 0) AS BIGINT) AS dorig, CAST(coalesce(sum(chunk_size) FILTER (kind <> 'DELTA'), 0) AS BIGINT) AS borig, avg(chunk_size // save_size) FILTER (kind = 'DELTA') AS dce
  FROM d, lo GROUP BY lc, lb),
z AS (SELECT *, logical_bytes - borig - dorig AS dedup_reduct, borig - base_bytes AS local_reduct, dorig - delta_bytes AS delta_reduct FROM a)"""


def _metrics(spark, sf_dir):
    c, u = small_chunks(spark, sf_dir)
    return metrics.reduction(block_decisions(u), c.agg(F.count("*").alias("logical_chunks"), F.sum("chunk_size").alias("logical_bytes")))


@register("reduction_metrics", f"""WITH RECURSIVE {_METRICS} SELECT logical_chunks, logical_bytes, unique_chunks, base_chunks, delta_chunks, stored_bytes, base_bytes, delta_bytes, logical_bytes / stored_bytes AS ocr, delta_chunks / unique_chunks AS dcc,
  CASE WHEN delta_bytes <> 0 THEN dorig / delta_bytes END AS dcr, dce, dedup_reduct, local_reduct, delta_reduct, CAST(0 AS BIGINT) AS feature_reduct, CAST(0 AS BIGINT) AS locality_reduct FROM z""")  # fmt: skip
def reduction_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@register("reduction_cascade", f"WITH RECURSIVE {_METRICS} SELECT logical_bytes / (logical_bytes - dedup_reduct) AS dedup_ratio, logical_bytes / (logical_bytes - dedup_reduct - local_reduct) AS lossless_ratio, logical_bytes / (logical_bytes - dedup_reduct - local_reduct - delta_reduct) AS delta_ratio FROM z")
def reduction_cascade(spark, sf_dir):
    return metrics.cascade(_metrics(spark, sf_dir))


@register("index_overhead_model", f"WITH RECURSIVE {_METRICS} SELECT unique_chunks * 112 AS fp_bytes, base_chunks * 120 AS sf_bytes, logical_chunks * 8 AS recipe_bytes, unique_chunks * 112 + base_chunks * 120 AS total_bytes, base_chunks * 3 AS sf_number FROM z")
def index_overhead_model(spark, sf_dir):
    return metrics.index_overhead(_metrics(spark, sf_dir))


@register("locality_overhead_model", f"""WITH RECURSIVE {_METRICS} SELECT unique_chunks * 40 AS fp_bytes, unique_chunks * 72 AS id_bytes, base_chunks * 48 AS sf_bytes, names * 12 AS name_bytes, logical_chunks * 8 AS recipe_bytes,
  unique_chunks * 112 + base_chunks * 48 + names * 12 AS total_bytes FROM z, (SELECT count(DISTINCT file_id) AS names FROM u JOIN d USING (chunk_id) WHERE kind <> 'DELTA')""")  # fmt: skip
def locality_overhead_model(spark, sf_dir):
    c, u = small_chunks(spark, sf_dir)
    d = cut(block_decisions(u))
    names_ = d.where("kind <> 'DELTA'").join(u.select("chunk_id", "file_id"), "chunk_id").agg(F.countDistinct("file_id").alias("names"))
    return metrics.locality_overhead(metrics.reduction(d, c.agg(F.count("*").alias("logical_chunks"), F.sum("chunk_size").alias("logical_bytes"))), names_)


@register("tiered_overhead_model", f"""WITH RECURSIVE {sql.tiered(sql.SMALL)}, n AS (SELECT count(*) AS sf_number FROM (SELECT DISTINCT tier, sf FROM t)), q AS (SELECT count(*) AS u FROM u), l AS (SELECT count(*) AS n FROM k)
SELECT u * 112 AS fp_bytes, sf_number * 40 AS sf_bytes, l.n * 8 AS recipe_bytes, u * 112 + sf_number * 40 AS total_bytes, sf_number FROM n, q, l""")  # fmt: skip
def tiered_overhead_model(spark, sf_dir):
    c, u = small_chunks(spark, sf_dir)
    stored = _tiered(u).select("tier", "sf").distinct().agg(F.count("*").alias("sf_number"))
    counts = u.agg(F.count("*").alias("unique_chunks")).crossJoin(c.agg(F.count("*").alias("logical_chunks")))  # one row by one row
    return metrics.tiered_overhead(counts, stored)


# ---- codecs and decisions; sizes depend on our codecs, so tests hold them against replays and round trips


@register("lz4_sizes")
def lz4_sizes(spark, sf_dir):
    return small_unique(spark, sf_dir).select("chunk_id", "chunk_size", codec.lz4_sizes("payload").alias("lz4_size"))


@register("delta_sizes")
def delta_sizes(spark, sf_dir):
    u = small_unique(spark, sf_dir)
    base = u.select(F.col("chunk_id").alias("base_id"), F.col("payload").alias("base"))
    return index.latest(super_features(u)).join(base, "base_id").join(u.select("chunk_id", "payload"), "chunk_id").select("chunk_id", "base_id", codec.delta_sizes("payload", "base").alias("delta_size"))


@register("delta_round_trip_mismatches", "SELECT doc_id AS chunk_id FROM documents WHERE false")
def delta_round_trip_mismatches(spark, sf_dir):
    u = small_unique(spark, sf_dir)
    base = u.select(F.col("chunk_id").alias("base_id"), F.col("payload").alias("base"))
    pairs = index.latest(super_features(u)).join(base, "base_id").join(u.select("chunk_id", "payload"), "chunk_id")
    return pairs.where(codec.delta_decode(codec.delta_encode("payload", "base"), "base") != F.col("payload")).select("chunk_id")


def _decisions(method):
    def run(spark, sf_dir):
        return ReductionPipeline("small_fastcdc", method).decide(*small_chunks(spark, sf_dir))["decisions"]

    return run


for _name, _method in (
    ("dedup_decisions", "dedup"), ("ntransform_decisions", "ntransform"), ("finesse_decisions", "finesse"), ("odess_decisions", "odess"), ("palantir_decisions", "palantir"), ("bisearch_decisions", "bisearch"),
    ("mibl_decisions", "mibl"), ("midf_decisions", "midf"), ("mibl2_decisions", "mibl2"), ("mibl3_decisions", "mibl3"), ("log2_decisions", "log2"), ("less4_decisions", "less4"),
    ("tree_cut_decisions", "tree_cut"), ("tree_greedy_decisions", "tree_greedy"), ("tree_layer_decisions", "tree_layer"),
):
    register(_name)(_decisions(_method))


@register("best_base_all_greedy")
def best_base_all_greedy(spark, sf_dir):
    """ReductionPipeline("small_fastcdc", "all_greedy")'s decisions. Features and LZ4 sizes are taken where chunks are cut;
    only the bytes of chunks that share a value move, cut once more for that."""
    c = segment.content_defined(files(spark, sf_dir), segment.SMALL_FASTCDC)
    wide = c.select(*dedup.PLACE, F.col("chunk_size").cast("int").alias("chunk_size"), F.unhex(F.sha2("payload", 256)).alias("fp"), codec.lz4_sizes("payload").cast("int").alias("lz4"), ft.odess_features("payload").alias("f"))
    wide = wide.withColumn("s", F.when(F.col("chunk_size") > ft.MIN_SIZE, ft.odess_super(F.col("f")))).select(*dedup.PLACE, "chunk_size", "fp", "lz4", *[F.col("s")[i].alias(f"s{i}") for i in range(3)])
    first = cut(dedup.first_occurrences(wide, "lz4", "s0", "s1", "s2").select("first.*", "chunk_size", "lz4", "s0", "s1", "s2"))
    unique = cut(dedup.numbered(first))
    # of a chunk's equal values the first counts
    values = F.array_distinct(F.array("s0", "s1", "s2"))
    sf = unique.where("s0 is not null").select("chunk_id", F.posexplode(values).alias("pos", "sf"))
    return reduce.by_all(unique.select("chunk_id", "chunk_size", "lz4", *dedup.PLACE), sf, c, dedup.PLACE)
