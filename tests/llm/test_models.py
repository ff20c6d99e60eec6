import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import neighbours, quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    p = quality.classify(docs, labels)
    rows = p.join(labels, "doc_id").collect()
    assert p.count() == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held) > 50
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (8, 1), (4, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.classify(edge, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(edge.limit(0), labels).count() == 0
    assert quality.keep_good(edge, labels, 0.0).columns == edge.columns
    ids = spark.range(50).select(F.col("id").alias("d"), quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["d"]).encode()) % 3 == 1) for r in ids)


TEXTS = ["The cat, the dog & a_cat 42!", None, "", "one", "un café noir — 7 fois", "the the the the dog", "a b c d e f g h " * 9]


def test_word_vectors_against_plain_loops(spark):
    words = [quality.WORD.findall(t or "") for t in TEXTS]
    bucket = lambda w: zlib.crc32(w.encode()) % quality.BUCKETS
    plus, minus = quality.random_index()
    want = {}
    for own in words:
        for i, w in enumerate(own):
            v = want.setdefault(bucket(w), [0] * quality.DIMS)
            for j in range(max(0, i - quality.WINDOW), min(len(own), i + quality.WINDOW + 1)):
                if j != i:
                    v[plus[bucket(own[j])]] += 1
                    v[minus[bucket(own[j])]] -= 1
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    assert got.shape == (quality.BUCKETS, quality.DIMS) and set(np.flatnonzero(got.any(axis=1))) <= set(want)
    for b, v in want.items():
        n = sum(x * x for x in v) ** 0.5
        assert np.allclose(got[b], np.array(v) / (n or 1), atol=1e-6)
    # pooling
    pooled = quality.pool(got, quality.Tokens(), TEXTS)
    for row, own in zip(pooled, words, strict=True):
        vectors = [got[bucket(w)].astype(float) for w in own]
        for d in range(quality.DIMS):
            x = [v[d] for v in vectors]
            mean = sum(x) / len(x) if x else 0.0
            spread = max(0.0, sum(a * a for a in x) / len(x) - mean * mean) ** 0.5 if x else 0.0
            assert abs(row[d] - mean) < 1e-6 and abs(row[quality.DIMS + d] - spread) < 1e-3
    assert (quality.pool(got, quality.Tokens(), ["x y " * 70_000])[0] == quality.pool(got, quality.Tokens(), ["x y " * 70_000, ""])[0]).all()


def test_gradients_and_scores_against_plain_loops():
    r = np.random.default_rng(2)
    params = [r.normal(size=(5, 4)), r.normal(size=4), r.normal(size=4), r.normal(size=1)]
    a, b = r.normal(size=(7, 5)), r.integers(0, 2, 7).astype(float)

    def logit(x):
        hidden = [np.tanh(sum(x[i] * params[0][i, j] for i in range(5)) + params[1][j]) for j in range(4)]
        return sum(h * params[2][j] for j, h in enumerate(hidden)) + params[3][0]

    def loss():
        own = sum(np.log1p(np.exp(-logit(x) if y else logit(x))) for x, y in zip(a, b, strict=True)) / len(b)
        return own + quality.DECAY / 2 * ((params[0] ** 2).sum() + (params[2] ** 2).sum())

    got = quality.gradients(params, a, b)
    for p, g in zip(params, got, strict=True):
        for i in np.ndindex(p.shape):
            old, step = p[i], 1e-6
            p[i] = old + step
            up = loss()
            p[i] = old - step
            down = loss()
            p[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 1e-6
    net = quality.Network(np.full(5, 0.5), np.full(5, 2.0), *params[:3], params[3][0], 1.7)
    x = a * 2 + 0.5
    assert np.allclose(net.scores(x), [1 / (1 + np.exp(-logit(v) / 1.7)) for v in a])


def test_sample_bounds_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    old = quality.fit
    quality.fit = lambda x, y: (seen.append(len(x)), old(x, y))[1]
    try:
        quality.train(docs, labels, sample=40)
    finally:
        quality.fit = old
    assert seen and seen[0] <= 40


def brute(ids, x, k, every):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = sorted(((-float(q @ v), j) for j, v in zip(ids, x, strict=True) if j != i))[:k]
            out[i] = [(j, -a) for a, j in s]
    return out


@pytest.mark.parametrize("same", [0, 900])
def test_recall(spark, same):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 12)) + 3 * r.normal(size=(30, 12))[np.arange(3000) % 30]
    x[100 : 100 + same] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for g in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(g["query_id"], []).append((g["vec_id"], g["score"]))
    want = brute(list(range(3000)), x, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    if same:  # ties go to the smaller ids
        assert [a for a, _ in got[200]] == [a for a, _ in want[200]]


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, [0.0, 1.0], "y"), (2, None, None), (3, [0.0, 0.0], "z"), (4, [nan, 1.0], ""), (5, [inf, 1.0], ""), (6, [1.0, None], ""), (7, [1.0], ""), (20, [0.5, 0.5], ""), (None, [1.0, 1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = sorted(map(tuple, neighbours.search(df).collect()))
    assert got == [(0, 1, 20, 0.5), (0, 2, 1, 0.0), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id = 0")).count() == 0


def test_repeated_vec_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0])]
    got = sorted(map(tuple, neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()))
    want = []
    for q in (0, 20):
        each = [(-sum(a * b for a, b in zip(x, y, strict=True)), j) for i, x in rows if i == q for j, y in rows if j != q]
        want += [(q, n + 1, j, -s + 0.0) for n, (s, j) in enumerate(sorted(each)[:20])]
    assert got == sorted(want)


def test_many_queries_and_leaves_in_small_batches(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    plain = neighbours.lean

    def watched(run):
        def batches_of(batches):
            for b in run(batches):
                assert b.nbytes < 2 << 20
                yield b

        return plain(batches_of)

    monkeypatch.setattr(neighbours, "lean", watched)
    monkeypatch.setattr(neighbours, "LEAF_POINTS", 4)
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 7 * 48, raising=False)  # groups of seven vectors: some leaves are dealt over several
    want = brute(list(range(2000)), x.astype(np.float64), 20, 2)
    got = {}
    for g in neighbours.search(df, every=2).orderBy("query_id", "rank").collect():
        got.setdefault(g["query_id"], []).append((g["vec_id"], g["score"]))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    assert all(abs(s - float(x[q].astype(np.float64) @ x[a])) < 1e-9 for q in got for a, s in got[q])
