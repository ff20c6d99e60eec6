import random
import re

import pandas as pd
from pyspark.sql import functions as F

from chunkloom.functions import features as ft
from chunkloom.functions import names
from chunkloom.sources import corpus


def chunks_of_many_kinds():
    r = random.Random(1)
    return [b"", b"a", bytes(300), bytes(r.randrange(256) for _ in range(1000)), b"abc " * 200, *(bytes(r.choice(b"abcdefgh ") for _ in range(n)) for n in (47, 48, 60, 61, 64, 65, 575, 576, 577, 5000))]


def test_odess_against_the_rolling_loop():
    gear, chunks = ft.gear64().tolist(), chunks_of_many_kinds()
    got = ft.odess(chunks, 0x3F).tolist()
    for c, f in zip(chunks, got, strict=True):
        h, best = 0, [0] * 12
        for b in c:
            h = ((h << 1) + gear[b]) % 2**64
            if not h & 0x3F:
                best = [max(x, (h * m + a) % 2**64) for x, m, a in zip(best, ft.TRANSFORM_A, ft.TRANSFORM_B, strict=True)]
        assert f == best


def test_finesse_against_the_rolling_loop():
    for c in chunks_of_many_kinds():
        want = []
        for i in range(12):
            p = c[len(c) * i // 12 : len(c) * (i + 1) // 12]
            hashes = [0]
            for j in range(len(p) - 47):
                h = 0
                for b in p[j : j + 48]:
                    h = (h * 37 + b) % 1_000_000_007
                hashes.append(h)
            want.append(max(hashes))
        assert ft.finesse(c) == want


def test_ntransform_against_the_plain_loop():
    for c in chunks_of_many_kinds():
        windows = []
        for j in range(len(c) - 64):
            h = 0
            for b in c[j : j + 64]:
                h = (h * 257 + b) % 2**64
            windows.append(h)
        want = []
        for m, a in zip(ft.TRANSFORM_A, ft.TRANSFORM_B, strict=True):
            top, at = 0, 0
            for h in windows:
                v = (h * m + a) & 0xFFFFFFFF
                if v > top:
                    top, at = v, h
            want.append(at & 0xFFFFFFFF)
        assert ft.ntransform(c) == want


def test_super_features(spark):
    f = [[5, 1, 9, 2, 2, 8, 7, 7, 7, 4, 6, 3], [9, 5, 1, 8, 2, 2, 7, 7, 7, 3, 4, 6], [0] * 12]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(f)], "i long, f array<bigint>")
    rows = df.select(ft.finesse_super(F.col("f")).alias("a"), ft.odess_super(F.col("f")).alias("b"), ft.ntransform_super(F.col("f")).alias("c"), ft.tiered_super(F.col("f")).alias("d")).collect()
    assert rows[0]["a"] == rows[1]["a"] != rows[2]["a"]  # ranked within groups
    assert len(rows[0]["b"]) == len(rows[0]["c"]) == 3 and len({x["sf"] for x in rows[0]["d"]}) == 13
    assert rows[2]["b"][0] == rows[2]["b"][1]


def test_natural_order(spark):
    paths = ["src10", "src2", "SRC1", "a/b10/c", "a/b9/c", "src2b", ""]
    got = [r["p"] for r in spark.createDataFrame([(p,) for p in paths], "p string").orderBy(corpus.natural_key(F.col("p"))).collect()]
    key = lambda p: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", p.upper())]
    assert got == sorted(paths, key=key)


def test_names(spark):
    rows = [("v1/a/b.c",), ("v1",), ("v1/a/b/c/d.e",), ("/x",), ("v/a",), (None,), ("",)]
    got = spark.createDataFrame(rows, "n string").select(names.strip_version(F.col("n")).alias("s"), names.directory_path(F.col("n")).alias("d"), names.name_hash("n").alias("h")).collect()
    assert [r["s"] for r in got] == ["a/b.c", "v1", "a/b/c/d.e", "x", "a", None, ""]
    assert [r["d"] for r in got][:5] == ["/a", None, "/a/b", "/", "/"]
    h = 0
    for b in b"v1/a/b.c":
        h = (h * names.NAME_PRIME + b) % 2**64
    assert got[0]["h"] == str(h) and got[6]["h"] == "0" and got[5]["h"] is None
    assert isinstance(pd.Series([1]), pd.Series)
