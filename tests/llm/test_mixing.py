import math
import random

import numpy as np

from chunkloom.llm import mixing


def water(sizes, weights=(5, 2, 1), factor=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = factor * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_copies(spark):
    r = random.Random(4)
    rows = [(i, "w " * min(3000, int(r.paretovariate(0.9) * 10)), r.choice(["a", "b", "é", "zz", None, "hot", "hot", "hot"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    for g in got:
        assert abs(g["target"] - want[g["source"]]) < 1e-6 * want[g["source"]] and g["source_size"] == sizes[g["source"]]
        assert 0 <= g["taken"] <= 2 * g["size"]
        taken[g["source"]] += g["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 50
    assert len(got) == len(rows)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted((g["doc_id"], g["taken"]) for g in got) == sorted((g["doc_id"], g["taken"]) for g in again)


def test_edges(spark, edge):
    got = mixing.mix(edge).collect()
    assert len(got) == edge.count()
    assert all(g["taken"] == 0 for g in got if g["size"] == 0)
    assert mixing.mix(edge.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted((g["doc_id"], g["target"], g["taken"]) for g in mixing.mix(empty).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def dual(sizes, target, cap=2.0):
    """The solution of one source's dual by bisection on plain arrays."""
    n = np.array(sizes, float)
    x = np.log1p(n) / math.log1p(n.sum() / len(n))
    tokens = lambda lam: float((n * np.minimum(cap, np.exp(np.minimum(lam * x, 64)))).sum())
    lo, hi = -600.0, 600.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tokens(mid) < target else (lo, mid)
    return np.minimum(cap, np.exp(np.minimum(lo * x, 64)))


def test_rates_against_a_plain_dual(spark):
    r = random.Random(6)
    rows = [(i, "w " * r.choice([1, 2, 5, 40, 700]), "abcdef"[min(5, int(r.expovariate(0.7)))]) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    for s in "abcdef":
        own = [g for g in got if g["source"] == s]
        if own[0]["target"] >= 2 * own[0]["source_size"] * (1 - 1e-9):
            assert all(g["copies"] == 2 for g in own)
            continue
        want = dual([g["size"] for g in own], own[0]["target"])
        assert max(abs(g["rate"] - w) for g, w in zip(own, want, strict=True)) < 1e-3
        # a weight that is the same for all would be further from 1 in the divergence named
        x = np.array([math.log1p(g["size"]) for g in own]) / math.log1p(own[0]["source_size"] / len(own))
        q = np.array([g["size"] for g in own]) / x
        flat = own[0]["target"] / own[0]["source_size"]
        apart = lambda w, q=q: float((q * (w * np.log(w) - w + 1)).sum())
        assert apart(want) <= apart(np.full(len(own), flat)) + 1e-9


def test_reruns_agree_on_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 64)
    r = random.Random(7)
    rows = [(r.choice([None, None, 1, 2, 3, r.randrange(500)]), "w " * r.choice([0, 1, 3, 9, 200]) + r.choice(["", "", "x", "y"]), r.choice("aab")) for _ in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    key = lambda g: repr(tuple(g))
    first = sorted(mixing.mix(df).collect(), key=key)
    assert len(first) == len(rows)
    for n in (1, 7):
        assert sorted(mixing.mix(df.repartition(n)).collect(), key=key) == first
    assert sorted(mixing.mix(df.orderBy("text", "source")).collect(), key=key) == first


def test_unsolved_dual_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_ROUNDS", 1)
    monkeypatch.setattr(mixing, "STEPS", 1)
    df = spark.createDataFrame([(i, "w " * (i % 50 + 1), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    try:
        mixing.mix(df)
    except RuntimeError:
        return
    raise AssertionError
