"""Catalog queries against their SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__
from chunkloom.plans import catalog

SF = "/root/testdata/sf0.001"
def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(plain(x) for x in r)) for r in got.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_matches_writes_no_chunks(spark, tmp_path):
    size = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    sc = spark.sparkContext
    before = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    sc.setCheckpointDir(str(tmp_path))
    try:
        assert __spark_entry__.queries()["sf_all_matches"](spark, SF).count()
        assert sum(p.stat().st_size for p in tmp_path.rglob("part-*")) < 0.7 * size
    finally:
        if before:
            sc.setCheckpointDir(os.path.dirname(before.removeprefix("file:")))


def test_best_base_all_greedy_writes_no_chunks(spark, tmp_path):
    size = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    sc = spark.sparkContext
    before = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    sc.setCheckpointDir(str(tmp_path))
    try:
        got = sorted(map(tuple, __spark_entry__.queries()["best_base_all_greedy"](spark, SF).collect()))
        assert sum(p.stat().st_size for p in tmp_path.rglob("part-*")) < size
        want = catalog.ReductionPipeline("small_fastcdc", "all_greedy").decide(*catalog.small_chunks(spark, SF))["decisions"].select("chunk_id", "kind", "base_id", "chunk_size", "save_size")
        assert got == sorted(map(tuple, want.collect())) and any(r[2] is not None for r in got)
    finally:
        if before:
            sc.setCheckpointDir(os.path.dirname(before.removeprefix("file:")))
