import hashlib
import random

import numpy as np
import pytest

from chunkloom.llm import bwt, components, jaccard, substrings, suffixes


def shingles(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= 80 * (len(a) + len(b) - k):
                    up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs, passage = [], say(60)
    for size, copies, edits in ((60, 60, 1), (40, 30, 2), (120, 40, 6), (8, 25, 1), (200, 3, 9)):
        base = say(size)
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append(w)
    docs += [passage + say(r.randint(1, 20)) for _ in range(40)]
    docs += [say(r.randint(1, 50)) for _ in range(40)] + [["to"] * r.randint(1, 80) for _ in range(8)]
    r.shuffle(docs)
    return [(3 * i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = sorted(map(tuple, jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=repr)
    assert got == classes(rows)


@pytest.mark.parametrize("one_task, hot", [(0, 1 << 16), (1 << 20, 8), (1 << 20, 2)])
def test_classes_in_blocks_and_rounds(spark, monkeypatch, one_task, hot):
    """With small blocks and groups dealt over buckets; each pair is verified once over all rounds."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    verified = []
    verify = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, texts: (verified.extend(map(tuple, pairs.select("a", "b").collect())), verify(pairs, texts))[1])
    rows = corpus(3)
    got = sorted(map(tuple, jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=repr)
    assert got == classes(rows)
    assert verified and len({frozenset(p) for p in verified}) == len(verified)


def test_blocks_of_a_large_class_do_not_meet(spark, monkeypatch):
    """A class of n members and r others give about 2 n rows, not n squared."""
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    n = 2000
    members = spark.createDataFrame([(7, i, 100, 0) for i in range(n + 5)] + [(8, i, 100, 0) for i in range(90)], "a long, b long, n long, pos long")
    labels = spark.createDataFrame([(i, 0) for i in range(n)], "node long, component long")
    rows = jaccard.dealt_blocks(members, labels).collect()
    assert {r["a"] for r in rows} == {7} and len(rows) <= n + 5 * (2 + n // 64 + 1)
    met = {}
    for r in rows:
        met.setdefault((r["x"], r["y"]), {}).setdefault(r["block"], set()).add(r["b"])
    for i in range(n, n + 5):  # each of the others meets every member once
        together = [b for p in met.values() if any(i in own for own in p.values()) for own in p.values() for b in own]
        assert set(range(n)) <= set(together)


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    r = random.Random(4)
    links = [(i, i + 1) for i in range(-40, 0)] + [(r.randint(1, 300), r.randint(1, 300)) for _ in range(120)] + [(500, 500), (1, 2), (1, 2)]
    up = {x: x for p in links for x in p}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    want = {x: c for x, c in up.items() if any(x in p and p[0] != p[1] for p in links)}
    frame = spark.createDataFrame(links, "a long, b long")
    assert dict(map(tuple, components.components(frame).collect())) == want
    assert components.components(frame.limit(0)).count() == 0


def test_class_edges(spark, edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted(map(tuple, jaccard.classes(edge).collect()), key=repr) == classes(rows)
    assert jaccard.classes(edge.limit(0)).count() == 0


def gone(units, length):
    """units: lists in order of documents -> marks of the units that go."""
    seen, out = {}, [[False] * len(u) for u in units]
    for d, u in enumerate(units):
        for i in range(len(u) - length + 1):
            if seen.setdefault(tuple(u[i : i + length]), (d, i)) != (d, i):
                out[d][i : i + length] = [True] * length
    return out


def expected_words(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    # rows with one id are not earlier than each other: those here are equal texts, so one of them stands for all
    first = list({d: t for d, t in rows}.items())
    units = [(t or "").encode().split() for _, t in first]
    marks = {d: (u, g) for (d, _), u, g in zip(first, units, gone(units, 20), strict=True)}
    out = []
    for d, _ in rows:
        u, g = marks[d]
        out.append((d, len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=repr)


def expected_bytes(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first = list({d: t for d, t in rows}.items())
    units = [(t or "").encode() for _, t in first]
    marks = {d: (u, g) for (d, _), u, g in zip(first, units, gone(units, 100), strict=True)}
    out = []
    for d, _ in rows:
        u, g = marks[d]
        spans = sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
        out.append((d, len(u), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(u, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_removed_words_and_bytes(spark, seed):
    rows = corpus(seed) + [(10_000 + i, ("ab " * 90 + "c") * (i + 1)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substrings.digests(df).collect()), key=repr) == expected_words(rows)
    assert sorted(map(tuple, suffixes.digests(df).collect()), key=repr) == expected_bytes(rows)


def test_removal_edges(spark, edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted(map(tuple, substrings.digests(edge).collect()), key=repr) == expected_words(rows)
    short = [(d, t[:3000] if t else t) for d, t in rows]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert sorted(map(tuple, suffixes.digests(df).collect()), key=repr) == expected_bytes(short)
    assert substrings.digests(edge.limit(0)).count() == suffixes.digests(edge.limit(0)).count() == 0
    clean = substrings.cleaned(edge)
    assert clean.columns == edge.columns and clean.count() == edge.count()
    assert {r.doc_id: r.text for r in clean.collect()}[2] == ""


def test_rows_with_one_id_and_other_texts(spark):
    """Compared by start alone: the reading that the docstrings state."""
    w, c = [f"w{i}" for i in range(30)], "".join(f"{i:04d}" for i in range(60))
    rows = [(5, w), (5, ["x", *w]), (6, w[:25] + ["y"]), (7, w[2:]), (7, w[2:] + ["z"]), (9, ["q"] * 30)]
    first = {}
    for d, own in rows:
        for i in range(len(own) - 19):
            key = tuple(own[i : i + 20])
            first[key] = min(first.get(key, (d, i)), (d, i))
    want = []
    for d, own in rows:
        gone = set()
        for i in range(len(own) - 19):
            if first[tuple(own[i : i + 20])] != (d, i):
                gone |= set(range(i, i + 20))
        want.append((d, len(own), len(gone)))
    df = spark.createDataFrame([(d, " ".join(own)) for d, own in rows], "doc_id long, text string").repartition(3)
    assert sorted((r[0], r[1], r[2]) for r in substrings.digests(df).collect()) == sorted(want)
    assert sorted(want)[:2] == [(5, 30, 0), (5, 31, 30)]
    df = spark.createDataFrame([(5, c), (5, "x" + c), (5, c + "y")], "doc_id long, text string")
    assert sorted((r[1], r[2]) for r in suffixes.digests(df).collect()) == [(240, 0), (241, 0), (241, 240)]


def test_compressed_index():
    r = np.random.default_rng(5)
    for sigma, n in ((1, 50), (2, 700), (300, 5000), (5000, 20000)):
        seq = np.minimum((r.exponential(sigma / 12, n)).astype(np.int64), sigma - 1)
        m = bwt.HuffmanMatrix(seq, sigma)
        i = r.integers(0, n + 1, 400)
        symbol = r.choice(seq, 400)
        want = [int((seq[:k] == c).sum()) for k, c in zip(i, symbol, strict=True)]
        assert (m.down(symbol, i) - m.down(symbol, np.zeros(400, np.int64))).tolist() == want
        bits = bwt.Bits(seq % 2 == 1)
        assert bits.ones(i).tolist() == [int((seq[:k] % 2 == 1).sum()) for k in i]
    counts = np.array([50, 1, 1, 7, 20])
    assert bwt.code_lengths(counts).tolist() == [1, 4, 4, 3, 2]
    size = np.full(400, 40)
    code = r.zipf(1.3, int(size.sum())).astype(np.uint64)
    index = bwt.FmIndex(code, size, np.arange(len(code)), 20)
    assert index.tree.nbytes + index.head.nbytes < 4 * len(code)


def test_index_of_segments():
    r = np.random.default_rng(0)
    size = r.integers(8, 30, 60)
    code = r.integers(0, 3, int(size.sum())).astype(np.uint64)
    b = bwt.Bwt(code, size, 6)
    text = [(int(x), i) for i, x in enumerate(b.text)]
    marked = [(0, -1000 + i) if x == 0 else (x, 0) for x, i in text]  # marks differ, in the order of segments
    assert sorted(range(b.n), key=lambda i: marked[i:]) == b.sa.tolist()
    divided = suffixes.bounded_intervals(b, 6)
    for k in range(1, b.n):
        a, c = marked[b.sa[k - 1] :][:6], marked[b.sa[k] :][:6]
        assert divided[k] == (a != c)
    place = np.arange(len(code))
    count = size - 5
    want = suffixes.first_places(code, size, count, place, 6)
    assert (want == substrings.matching_statistics(code, size, count, place, 6)).all()


def test_intervals_of_one_extension_take_no_rank_queries():
    r = np.random.default_rng(6)
    shared = r.integers(97, 101, 140)
    parts = [np.concatenate((r.integers(97, 101, 8), shared, r.integers(97, 101, 8))) for _ in range(20)] + [r.integers(97, 99, 60) for _ in range(5)]
    code, size = np.concatenate(parts).astype(np.uint8), np.array([len(x) for x in parts])
    b = bwt.Bwt(code, size, 100)
    asked, plain = [], b.tree.symbols
    b.tree.symbols = lambda lo, hi: asked.append(len(lo)) or plain(lo, hi)
    divided = suffixes.bounded_intervals(b, 100)
    tails = [x[i:].tolist() + [-len(parts) + n] for n, x in enumerate(parts) for i in range(len(x) + 1)]  # marks differ and sort first
    tails.sort()
    same = [next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), 0) for x, y in zip(tails, tails[1:], strict=False)]
    assert divided.tolist() == [True, *(n < 100 for n in same), True]
    assert sum(asked) < 0.25 * sum(len(x) for x in parts)


def test_suffixes_are_sorted_without_argsort_of_wide_keys(monkeypatch):
    r = np.random.default_rng(5)
    part = r.integers(0, 9, 300).astype(np.uint8)
    segments = [part[a:b] for a, b in (sorted(r.integers(0, 301, 2)) for _ in range(40))]
    code, size = np.concatenate(segments), np.array([len(x) for x in segments])
    wide, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **k: (wide.append(a.dtype.itemsize == 8), plain(a, *x, **k))[1])
    s = bwt.Suffixes(code, size, 100)
    assert not any(wide)
    text = [(*x, -1000 + i) for i, x in enumerate(map(tuple, segments))]  # each closed by a mark of its own
    want = sorted((t[i:], start + i) for t, start in zip(text, s.start.tolist(), strict=True) for i in range(len(t)))
    assert s.sa.tolist() == [at for _, at in want]
