import io
import random
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.functions.features import gear32, odess
from chunkloom.operators import archive, codec, dedup, index, metrics, reduce, segment, smallest, store
from chunkloom.operators.components import components, cut
from chunkloom.operators.pipeline import ReductionPipeline, super_features
from chunkloom.sources import corpus

FILES = "version_no int, file_id long, path string, content binary"


def sample_files(seed=0, n=12):
    r = random.Random(seed)
    base = bytes(r.choice(b"abcdefghijk lmnop\n") for _ in range(3000))
    out = []
    for i in range(n):
        b = bytearray(base)
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(b))
            b[at : at + r.randint(0, 30)] = bytes(r.choice(b"xyz") for _ in range(r.randint(0, 30)))
        out.append((i // 3, i, f"v{i // 3}", bytes(b)))
    return [*out, (9, 100, "v9", b""), (9, 101, "v9", b"z"), (9, 102, "v9", base)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(sample_files(), FILES).cache()


def slow_cuts(data, rule):
    gear, out, start = gear32().tolist(), [], 0
    while start < len(data):
        fp, n = 0, 0
        while start + n < len(data) and n < rule.most:
            n += 1
            if n > rule.least:
                fp = (fp >> 1) + gear[data[start + n - 1]]
                if fp & rule.mask == 0:
                    break
        start += n
        out.append(start)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([segment.SMALL_FASTCDC, segment.SMALL_GEARCDC, segment.Cdc(0, 3, 20), segment.Cdc(5, 1, 9)]))
def test_cuts(data, rule):
    assert segment.cut_points(data, rule) == slow_cuts(data, rule)


@pytest.mark.parametrize("cutter", [lambda f: segment.fixed(f, 64), lambda f: segment.content_defined(f, segment.SMALL_FASTCDC)])
def test_chunks_join_to_files(files, cutter):
    whole = {r["file_id"]: bytes(r["content"]) for r in files.collect()}
    got = {}
    for r in sorted(cutter(files).collect(), key=lambda r: (r["file_id"], r["seq"])):
        assert r["offset"] == len(got.setdefault(r["file_id"], b"")) and r["chunk_size"] == len(r["payload"])
        got[r["file_id"]] += bytes(r["payload"])
    assert got == {k: v for k, v in whole.items() if v}


def test_dedup_and_restore(files):
    c = cut(dedup.fingerprinted(segment.fixed(files, 64)))
    u = cut(dedup.unique_chunks(c))
    rows = sorted(u.collect(), key=lambda r: r["chunk_id"])
    assert [r["chunk_id"] for r in rows] == list(range(len(rows)))
    assert [tuple(r[x] for x in dedup.PLACE) for r in rows] == sorted(tuple(r[x] for x in dedup.PLACE) for r in rows)
    assert len(rows) == c.select("fp").distinct().count() == c.count() - dedup.duplicates(c).count()
    p = u.join(c.select(*dedup.PLACE, "payload"), dedup.PLACE).select("chunk_id", "payload")
    back = {r["file_id"]: bytes(r["content"]) for r in dedup.restore(dedup.recipes(c, u), p).collect()}
    assert back == {i: b for _, i, _, b in sample_files() if b}


def brute_index(rows, policy):
    """rows: (chunk, [sf by position]) in order."""
    slots, out = {}, {}
    for chunk, sfs in rows:
        for pos, sf in enumerate(sfs):
            seen = slots.get(sf, [])
            if seen:
                n = len(seen)
                at = {"latest": n - 1, "first": 0, "less4": min(n - 1, 4), "log2": 0 if n == 1 else 2 ** ((n - 1).bit_length() - 1)}[policy]
                out[chunk] = (seen[at], pos)
                break
        for sf in sfs:
            slots.setdefault(sf, []).append(chunk)
    return out


@pytest.mark.parametrize("span", [3, 1 << 16])
@pytest.mark.parametrize("policy", ["latest", "first", "log2", "less4"])
def test_index_policies(spark, monkeypatch, policy, span):
    monkeypatch.setattr(index, "SPAN", span)
    r = random.Random(2)
    rows = [(i, [f"s{r.randrange(1 + r.randrange(40))}" for _ in range(3)]) for i in range(400)] + [(1000 + i, ["X", "Y", "Z"]) for i in range(7)] + [(2000, ["Q", "X", "Q"])]
    sf = spark.createDataFrame([(c, p, s) for c, sfs in rows for p, s in enumerate(sfs)], "chunk_id long, pos int, sf string")
    got = {r["chunk_id"]: (r["base_id"], r["pos"]) for r in getattr(index, policy)(sf).collect()}
    assert got == brute_index(rows, policy)
    assert got[2000] == ({"latest": 1006, "first": 1000, "log2": 1004, "less4": 1004}[policy], 1)


@pytest.mark.parametrize("span", [1, 2, 1 << 16])
def test_all_matches_and_per_position(spark, monkeypatch, span):
    monkeypatch.setattr(index, "SPAN", span)
    sf = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "a"), (3, 0, "z"), (3, 1, "a")], "chunk_id long, pos int, sf string")
    assert sorted(map(tuple, index.all_matches(sf).collect())) == [(2, 1), (3, 1), (3, 2)]
    assert sorted(map(tuple, index.latest(sf, per_position=True).collect())) == [(3, 2, 1)]


@pytest.mark.parametrize("span", [2, 1 << 16])
def test_tiers_expire(spark, monkeypatch, span):
    monkeypatch.setattr(index, "SPAN", span)
    rows = [(0, 1, 2, 0, "x"), (0, 2, 3, 0, "y"), (0, 3, 1, 0, "w"), (6, 10, 2, 0, "x"), (3, 11, 3, 0, "y"), (99, 12, 1, 0, "w"), (5, 13, 2, 0, "q"), (6, 14, 2, 0, "x")]
    sf = spark.createDataFrame(rows, "version_no int, chunk_id long, tier int, pos int, sf string")
    assert sorted(map(tuple, index.tiered(sf, {2: 5, 3: 2}).collect())) == [(12, 3, 1, 0), (14, 10, 2, 0)]


def test_records(spark):
    records = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 2), ("c", 0, 3)], "key string, pos int, sf long")
    assert sorted(map(tuple, index.similar_records(records).collect())) == [("a", "b"), ("b", "a")]
    assert index.count_similar(records).first()["similar"] == 2
    changed = index.upsert(records, spark.createDataFrame([("b", 0, 3), ("a", 0, None)], "key string, pos int, sf long"))
    assert sorted(map(tuple, index.similar_records(changed).collect())) == [("b", "c"), ("c", "b")]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600), st.binary(max_size=600), st.integers(0, 600), st.integers(0, 600))
def test_deltas_come_back(a, b, i, j):
    target = b[:i] + a + b[j:]
    assert codec.decode(codec.encode(target, b), b) == target
    assert 0 <= codec.lz4_size(target) <= len(target)


def slow_replay(rows, method):
    """rows: (chunk, payload, sfs). The methods whose base is the hit itself."""
    m, index_, data, out = reduce.METHODS[method], {}, {}, {}
    for chunk, payload, sfs in rows:
        data[chunk] = payload
        keys = [(p, s) if m.per_position else s for p, s in enumerate(sfs)]
        hit = next((index_[k] for k in keys if k in index_), None)
        size = None if hit is None else len(codec.encode(payload, data[hit]))
        taken = size is not None and (m.accept == "always" or size <= len(payload))
        out[chunk] = hit if taken else None
        if not (taken and m.bases_only):
            for k in keys:
                if m.index == "latest" or k not in index_:
                    index_[k] = chunk
    return out


@pytest.fixture(scope="module")
def unique(files):
    c = cut(dedup.fingerprinted(segment.content_defined(files, segment.SMALL_FASTCDC)))
    return cut(dedup.unique_chunks(c).join(c.select(*dedup.PLACE, "payload"), dedup.PLACE))


@pytest.mark.parametrize("method", ["odess", "ntransform", "finesse", "mibl"])
def test_replay_equals_one_sequence(unique, method):
    family = method if method in ("ntransform", "finesse") else "odess"
    sf = super_features(unique, family, 60, zeros=False)
    by = {}
    for r in sf.collect():
        by.setdefault(r["chunk_id"], {})[r["pos"]] = r["sf"]
    rows = [(r["chunk_id"], bytes(r["payload"]), [by[r["chunk_id"]][p] for p in sorted(by.get(r["chunk_id"], {}))]) for r in sorted(unique.collect(), key=lambda r: r["chunk_id"])]
    got = {r["chunk_id"]: r["base_id"] for r in reduce.replay(unique, sf, method).collect()}
    assert got == slow_replay(rows, method) and any(v is not None for v in got.values())
    if method == "mibl":  # the join form of the same method
        assert got == {r["chunk_id"]: r["base_id"] for r in reduce.by_candidates(unique, index.latest(sf)).collect()}


@pytest.mark.parametrize("method", ["dedup", "palantir", "bisearch", "midf", "mibl2", "mibl3", "log2", "less4", "tree_cut", "tree_greedy", "all_greedy", "tree_layer"])
def test_every_chunk_is_decided_once(files, unique, method):
    out = ReductionPipeline("small_fastcdc", method).decide(unique, unique)
    d = out["decisions"].collect()
    assert sorted(r["chunk_id"] for r in d) == sorted(r["chunk_id"] for r in unique.collect())
    assert all((r["base_id"] is None) == r["kind"].startswith("BASE") and (r["base_id"] is None or r["base_id"] < r["chunk_id"]) and r["save_size"] >= 0 for r in d)
    m = out["metrics"].first()
    assert m["stored_bytes"] == sum(r["save_size"] for r in d) and m["unique_chunks"] == len(d) == m["base_chunks"] + m["delta_chunks"]
    if method != "dedup":
        assert m["delta_chunks"] > 0


def test_tree_methods_by_hand():
    r = random.Random(6)
    data = [bytes(r.randrange(256) for _ in range(400))]
    for i in range(8):
        data.append(data[-1][: 40 * i] + bytes(r.randrange(256) for _ in range(20)) + data[-1][40 * i + 20 :])
    for method in ("tree_cut", "tree_greedy", "tree_layer"):
        state = reduce.Replay(reduce.METHODS[method])
        out = [state.decide(i, d, [(0, 7)], []) for i, d in enumerate(data)]
        assert [x[2] for x in out] == [None, *range(8)] and out[-1][5] == 8  # each is nearest to the one before
    state = reduce.Replay(reduce.METHODS["tree_layer"])
    for i, d in enumerate([data[0], data[1], *[data[1][:-k] + bytes(k) for k in range(1, 8)]]):
        state.decide(i, d, [(0, 7)], [])
    assert state.index[(7,)] != 0  # a child that keeps winning takes its father's place in the index


def test_packing(spark):
    rows = [(0, i, n) for i, n in enumerate([3, 3, 3, 5, 2])] + [(1, 10, 8), (1, 11, 1)]
    df = spark.createDataFrame(rows, "version_no int, chunk_id long, stored long")
    got = store.pack(df, 8, restart=True).orderBy("chunk_id").collect()
    assert [(r["container_id"], r["container_offset"]) for r in got] == [(0, 0), (0, 3), (1, 0), (1, 3), (2, 0), (0, 0), (1, 0)]
    got = store.pack(df, 8).orderBy("chunk_id").collect()
    assert [(r["container_id"], r["container_offset"]) for r in got] == [(0, 0), (0, 3), (1, 0), (1, 3), (2, 0), (3, 0), (4, 0)]


@pytest.mark.parametrize("run", [1, 3, 50, 1 << 20])
def test_packing_in_runs_equals_one_pass(spark, run):
    r = random.Random(run)
    sizes = [r.choice([1, 5, 30, 99, 100]) for _ in range(400)]
    got = store.pack(spark.createDataFrame([(i // 130, i, n) for i, n in enumerate(sizes)], "version_no int, chunk_id long, stored long").repartition(3), 100, run=run).orderBy("chunk_id").collect()
    container = fill = 0
    want = []
    for n in sizes:
        if fill and fill + n > 100:
            container, fill = container + 1, 0
        want.append((container, fill))
        fill += n
    assert [(x["container_id"], x["container_offset"]) for x in got] == want


@pytest.mark.parametrize("tree_bytes", [0, 1 << 20])
@pytest.mark.parametrize("grown", [False, True])
def test_stored_chunks_come_back(spark, monkeypatch, tree_bytes, grown):
    monkeypatch.setattr(store, "TREE_BYTES", tree_bytes)
    r = random.Random(3)
    data = [bytes(r.choice(b"abcd") for _ in range(300)), b"", b"z" * 500]
    for i in range(40):
        base = bytearray(data[r.randrange(len(data))])
        at = r.randint(0, len(base))
        base[at:at] = bytes(r.choice(b"xyz") for _ in range(r.randint(0, 40)))
        data.append(bytes(base))
    up = {i: r.randrange(i) for i in range(3, len(data)) if i % 5}
    unique = spark.createDataFrame(list(enumerate(data)), "chunk_id long, payload binary").repartition(3)
    decisions = spark.createDataFrame([(i, "DELTA" if i in up else "BASE_LZ4", up.get(i)) for i in range(len(data))], "chunk_id long, kind string, base_id long")
    stored = cut(store.encode_stored(unique, decisions, grown))
    assert {x["chunk_id"]: bytes(x["payload"]) for x in store.decode_stored(stored, grown).collect()} == dict(enumerate(data))
    wanted = spark.createDataFrame([(42,), (17,), (17,)], "chunk_id long")
    assert {x["chunk_id"]: bytes(x["payload"]) for x in store.read_chunks(stored, wanted, grown).collect()} == {i: data[i] for i in (42, 17)}
    line = {42, 17}
    for i in (42, 17):
        while i in up:
            i = up[i]
            line.add(i)
    assert {x["chunk_id"] for x in store.with_ancestors(wanted, stored.select("chunk_id", "base_id")).collect()} == line
    meta = store.read_meta(stored, wanted)
    assert "stored" not in meta.columns and {x["chunk_id"]: x["chunk_size"] for x in meta.collect()} == {i: len(data[i]) for i in (42, 17)}
    # a chunk whose root is damaged does not come back, and nothing that builds on it
    broken = stored.withColumn("stored", F.when(F.col("chunk_id") == 0, F.lit(b"x" * 300)).otherwise(F.col("stored")))
    back = {x["chunk_id"]: x["payload"] for x in store.decode_stored(broken, grown).collect()}
    assert len(back) == len(data) and bytes(back[2]) == data[2] and bytes(back[0]) == b"x" * 300


def test_containers_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, i // 4, i % 4, bytes([i])) for i in range(20)], "chunk_id long, container_id long, container_offset long, stored binary")
    store.write_containers(rows, str(tmp_path / "c"))
    wanted = rows.where("chunk_id in (3, 5, 6)").select("container_id", "chunk_id")
    assert sorted((r["chunk_id"], bytes(r["stored"])) for r in store.read_containers(spark, str(tmp_path / "c"), wanted).collect()) == [(i, bytes([i])) for i in (3, 5, 6)]
    assert tuple(store.container_loads(wanted).first()) == (3, 2, 1 / 3)


def test_restore_in_pieces(files):
    c = cut(dedup.fingerprinted(segment.fixed(files, 64)))
    u = cut(dedup.unique_chunks(c))
    p = u.join(c.select(*dedup.PLACE, "payload"), dedup.PLACE).select("chunk_id", "payload")
    rows = sorted(dedup.restore_pieces(dedup.recipes(c, u), p, 1000).collect(), key=lambda r: (r["file_id"], r["piece"]))
    back = {}
    for r in rows:
        assert 0 < len(r["content"]) < 1000 + 64
        back[r["file_id"]] = back.get(r["file_id"], b"") + bytes(r["content"])
    assert back == {i: b for _, i, _, b in sample_files() if b}


def test_chains(spark):
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (5, 4), *[(i + 1, i) for i in range(10, 60)]], "chunk_id long, base_id long")
    got = {r["node"]: (r["root"], r["depth"]) for r in store.chains(edges, cut).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 2), 5: (4, 1)} | {i: (10, i - 10) for i in range(11, 61)}
    assert {r["root"]: (r["nodes"], r["deepest"]) for r in store.subtree_sizes(edges, cut).collect()}[0] == (4, 2)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(5, 5)] + [(1000 + i, 1001 + i) for i in range(100)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_metrics(spark):
    d = spark.createDataFrame([(0, "BASE_LZ4", 100, 60, True), (1, "DELTA", 100, 30, False), (2, "DELTA", 100, 60, False), (3, "BASE_RAW", 50, 50, False)], "chunk_id long, kind string, chunk_size long, save_size long, is_header boolean")
    logical = spark.createDataFrame([(6, 500)], "logical_chunks long, logical_bytes long")
    m = metrics.reduction(d, logical)
    r = m.first()
    assert (r["ocr"], r["dcc"], r["dcr"], r["dce"], r["dedup_reduct"], r["local_reduct"], r["delta_reduct"]) == (2.5, 0.5, 200 / 90, 2.0, 150, 40, 110)
    c = metrics.cascade(m).first()
    assert (c["dedup_ratio"], c["lossless_ratio"], c["delta_ratio"]) == (500 / 350, 500 / 310, 2.5)
    assert metrics.index_overhead(m).first()["total_bytes"] == 4 * 112 + 2 * 120
    assert metrics.by_header(d).count() == 3


def tar_bytes(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark):
    members = [("v1/a.txt", b"hello"), ("v1/d", None), ("v1/" + "long" * 40, b"x" * 1000), ("v1/empty", b""), ("v1/big", bytes(range(256)) * (17 << 10))]
    t = tar_bytes(members)
    for headers in (0, 2, 16):
        rows = archive.tar_chunks(t, headers)
        assert sum(len(r[2]) for r in rows) == len(t)
        assert any(r[0] == "big" for r in rows)
        if not headers:
            assert b"".join(r[2] for r in rows) == t
        else:
            assert all(len(r[2]) <= headers * 512 for r in rows if r[0] == "header")
    assert archive.join_headers(archive.split_headers(t)) == t
    df = spark.createDataFrame([(0, 1, "a.tar", t), (0, 2, "b.tar", b"")], FILES)
    assert {r["file_id"] for r in archive.tar_segments(df, 16).collect()} == {1}
    there = archive.rewrite(df)
    assert {r["file_id"]: bytes(r["content"]) for r in archive.rewrite(there, back=True).collect()} == {1: t, 2: b""}


def test_directory_source_and_exports(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for n in ("f10", "f2", "sub/F1"):
        (tmp_path / "in" / n).write_bytes(n.encode() * 100)
    f = corpus.directory(spark, f"file://{tmp_path}/in")
    assert [r["path"].rsplit("/", 1)[1] for r in f.orderBy("version_no").collect()] == ["f2", "f10", "F1"]
    assert corpus.first_versions(f, 2).count() == 2
    out = ReductionPipeline("small_fixed", "mibl").run(f)
    u = out["unique"]
    placed = out["containers"].join(u.select("chunk_id", "payload"), "chunk_id")
    store.write_containers(placed, f"{tmp_path}/containers")
    back = store.read_containers(spark, f"{tmp_path}/containers", out["containers"].select("container_id", "chunk_id").limit(2))
    assert back.count() == 2
    store.export_csv(out["decisions"], f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").count() == u.count()
    for _ in range(2):
        store.append_report(out["metrics"], f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2


def test_versions_arriving(spark, files, tmp_path):
    from chunkloom.streaming.versions import IncrementalDedup

    for v in (0, 1, 2, 9):
        files.where(F.col("version_no") == v).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    inc = IncrementalDedup(spark, f"file://{tmp_path}/state", 64)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = inc.start(stream, f"{tmp_path}/checkpoint")
    q.awaitTermination(120)
    rows = inc.log().collect()
    c = dedup.fingerprinted(segment.fixed(files.where("version_no in (0, 1, 2, 9)"), 64))
    assert len(rows) == 4 and sum(r["new_chunks"] for r in rows) == c.select("fp").distinct().count() and sum(r["logical_chunks"] for r in rows) == c.count()
    assert all(r["seconds"] > 0 and r["bytes_a_second"] >= r["reduced_a_second"] >= 0 for r in inc.throughput().collect())
    want = {r["file_id"]: bytes(r["content"]) for r in files.where("version_no in (0, 1, 2, 9)").collect() if r["content"]}
    assert {r["file_id"]: bytes(r["content"]) for r in inc.restore().collect()} == want
    assert {r["file_id"] for r in inc.restore(1).collect()} < set(want)
    inc.process(files.where("version_no = 9"), 3)  # a batch that runs again changes nothing
    assert sum(r["new_chunks"] for r in inc.log().collect()) == sum(r["new_chunks"] for r in rows)


def slow_choice(m, hit, target, data, up, children):
    """The base of one chunk under the methods that look past the hit, by plain loops; None for the content of a chain."""
    size = lambda c: len(codec.encode(target, data[c]))
    chain = [hit]
    while chain[-1] in up:
        chain.append(up[chain[-1]])
    if m == "chain_size":
        return min(chain[::-1], key=size)
    best, least = hit, size(hit)
    queue = list(children.get(hit, ()))
    while m == "subtree" and queue:
        c = queue.pop(0)
        queue += children.get(c, ())
        if size(c) < least:
            best, least = c, size(c)
    while m == "descent":
        father = best
        for c in children.get(father, ()):
            if size(c) < least:
                best, least = c, size(c)
        if best == father:
            break
    return best


def short_texts(seed, n=120):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(60)]
    out = []
    for _ in range(n):
        t = " ".join(r.choice(words) for _ in range(r.randint(10, 40)))
        if out and r.random() < 0.6:
            old = r.choice(out)
            at = r.randrange(len(old))
            t = old[:at] + t[: r.randint(0, 60)] + old[at + r.randint(0, 40) :]
        out.append(t)
    return [t.encode() for t in dict.fromkeys(out)]


@pytest.mark.parametrize("method", ["mibl2", "tree_cut", "tree_greedy", "midf"])
def test_one_group_by_plain_loops(method):
    m = reduce.METHODS[method]
    for seed in range(4):
        data, up, children, literals, index_, state = {}, {}, {}, {}, None, reduce.Replay(m)
        for c, t in enumerate(short_texts(seed)):
            base = size = None
            if index_ is not None:
                base = index_ if m.choose == "literals" else slow_choice(m.choose, index_, t, data, up, children)
                content = data[base]
                if m.choose == "literals":
                    chain = [base]
                    while chain[-1] in up:
                        chain.append(up[chain[-1]])
                    content = data[chain[-1]] + b"".join(literals[x] for x in chain[-2::-1])
                size = len(codec.encode(t, content))
                if size <= len(t):
                    up[c], literals[c] = base, codec.added_bytes(t, content)
                    children.setdefault(base, []).append(c)
                else:
                    base = None
            data[c] = t
            if index_ is None or m.index == "latest":
                index_ = c
            got = state.decide(c, t, [(0, 7), (1, 7), (2, 7)], [])
            assert got[2] == base and (base is None or got[4] == size)
        assert len(set(up.values())) > 3


@pytest.fixture(scope="module")
def featureless(spark):
    """Chunks, most of which have no sampled position."""
    rows = [(i, 0, i, 0, f"f{i}", len(t), 1, t) for i, t in enumerate(short_texts(9) + [x[:50] for x in short_texts(10, 20)])]
    return spark.createDataFrame(rows, "chunk_id long, version_no int, file_id long, seq int, fp string, chunk_size int, copies int, payload binary").cache()


@pytest.mark.parametrize("method", ["odess", "mibl", "ntransform", "finesse", "palantir", "midf", "mibl2", "mibl3", "tree_cut", "tree_greedy", "tree_layer"])
def test_chunks_with_zero_features_match(featureless, method):
    family, gate = (method, -1) if method in ("ntransform", "finesse") else ("odess", 60)
    sf = super_features(featureless, family, gate)
    zero = {r["chunk_id"] for r in sf.collect()} - {r["chunk_id"] for r in super_features(featureless, family, gate, zeros=False).collect()}
    d = {r["chunk_id"]: r["base_id"] for r in ReductionPipeline("small_fastcdc", method).decide(featureless, featureless)["decisions"].collect()}
    assert len(zero) > 10 and sum(d[c] is not None for c in zero) > 5
    if method in ("odess", "mibl", "ntransform", "finesse"):
        by = {}
        for r in sf.orderBy("pos").collect():
            by.setdefault(r["chunk_id"], []).append(r["sf"])
        assert d == slow_replay([(r["chunk_id"], bytes(r["payload"]), by.get(r["chunk_id"], [])) for r in featureless.orderBy("chunk_id").collect()], method)


def test_all_greedy_tries_all_of_the_zero_group(featureless):
    sf = super_features(featureless)
    want = {r["chunk_id"]: (r["base_id"], r["save_size"]) for r in reduce.by_candidates(featureless, index.all_matches(sf)).collect()}
    d = ReductionPipeline("small_fastcdc", "all_greedy").decide(featureless, featureless)["decisions"].collect()
    assert {r["chunk_id"]: (r["base_id"], r["save_size"]) for r in d} == want and sum(b is not None for b, _ in want.values()) > 10
    assert reduce.close_matches(featureless, sf).count() < index.all_matches(sf).count()


def test_tiered_replay_forgets_old_versions(spark):
    """Values of tiers 2 and 3 by hand; a duplicate of a base renews them, one of a delta does not."""
    r = random.Random(3)
    text = bytes(r.randrange(256) for _ in range(300))
    row = lambda c, v, i: (c, v, c, i, text + bytes([c]) * 9)
    rows = [row(0, 0, 0), row(1, 6, 0), row(2, 7, 0), row(3, 0, 0), row(4, 3, 0), row(5, 4, 0), row(6, 0, 0), row(7, 9, 0), row(8, 0, 0), row(9, 1, 0), row(10, 8, 0), row(11, 0, 0), row(12, 99, 0)]
    sf = [(c, pos, v) for cs, pos, v in (((0, 1, 2), 20, 1), ((3, 4, 5), 30, 2), ((6, 7), 20, 3), ((8, 9, 10), 20, 4), ((11, 12), 10, 5)) for c in cs]
    unique = spark.createDataFrame(rows, "chunk_id long, version_no int, file_id long, seq int, payload binary")
    repeats = spark.createDataFrame([(6, 3, 500, 0), (9, 5, 500, 0)], "chunk_id long, version_no int, file_id long, seq int")
    got = reduce.replay(unique, spark.createDataFrame(sf, "chunk_id long, pos int, sf long"), "palantir", repeats=repeats).collect()
    want = {0: None, 1: 0, 2: None, 3: None, 4: 3, 5: None, 6: None, 7: 6, 8: None, 9: 8, 10: None, 11: None, 12: 11}
    assert {r["chunk_id"]: r["base_id"] for r in got} == want


def test_tiered_pipeline_renews_bases_by_duplicates(spark):
    r = random.Random(4)

    def plain(begin=b""):  # without sampled positions, so all share their values
        while True:
            b = begin + bytes(r.randrange(256) for _ in range(80 - len(begin)))
            if not odess([b]).any():
                return b

    a = plain()
    for again, want in ((), None), ((a,), 0):
        data = [a, plain(), *again, plain(a[:60])]  # the latest base is the second chunk, or the first one, stored anew
        c = spark.createDataFrame([(i, i, 0, len(b), b) for i, b in enumerate(data)], "version_no int, file_id long, seq int, chunk_size int, payload binary")
        c = cut(dedup.fingerprinted(c))
        u = cut(dedup.unique_chunks(c).join(c.select(*dedup.PLACE, "payload"), dedup.PLACE))
        assert {x["chunk_id"]: x["base_id"] for x in ReductionPipeline("small_fastcdc", "palantir").decide(c, u)["decisions"].collect()} == {0: None, 1: None, 2: want}


def test_locality_by_member_name_or_chunk_before(spark):
    r = random.Random(8)
    one, two = (bytes(r.randrange(256) for _ in range(3000)) for _ in range(2))
    old, new = tar_bytes([("p-1/a", one), ("p-1/b", two)]), tar_bytes([("p-2/a", one[:2900] + bytes(100)), ("p-2/b", two[:2900] + bytes(100))])
    out = ReductionPipeline("tar", "bisearch").run(spark.createDataFrame([(0, 1, "p-1.tar", old), (1, 2, "p-2.tar", new)], FILES))
    d, payload = {x["chunk_id"]: x for x in out["decisions"].collect()}, {x["chunk_id"]: bytes(x["payload"]) for x in out["unique"].collect()}
    for data in (one, two):
        (was,) = (c for c, b in payload.items() if b[:3000] == data)
        (now,) = (c for c, b in payload.items() if b[:2900] == data[:2900] and c != was)
        assert (d[now]["kind"], d[now]["base_id"]) == ("LOCAL_DELTA", was)
    files = spark.createDataFrame([(0, 1, "x", one[:64]), (1, 2, "y", one[:60] + b"diff")], FILES)
    assert ReductionPipeline("small_fixed", "bisearch").run(files)["decisions"].where("kind = 'LOCAL_DELTA'").count() == 1


def test_tree_cache_decides_as_tree_layer(unique):
    a, b = (sorted(map(tuple, ReductionPipeline("small_fastcdc", m).decide(unique, unique)["decisions"].collect())) for m in ("tree_cache", "tree_layer"))
    assert a == b and a


def test_long_names_and_archive_recipes(spark):
    from test_methods import archives

    rows = archives()
    found = list(archive.blocks(rows[0][3]))
    assert [n for kind, _, _, n in found if len(n) > 100] == ["v0/long/" + "n" * 120] * 4 and found[0][3] == "v0/dir/0.txt"
    out = ReductionPipeline("tar_headers", "dedup", headers=4, versions=3).run(spark.createDataFrame(rows, FILES))
    assert {r["part"] for r in out["recipes"].collect()} == {"header", "data"}
    back = archive.restore_archives(out["recipes"], out["unique"].select("chunk_id", "payload"))
    assert {r["file_id"]: bytes(r["content"]) for r in back.collect()} == {i: b for v, i, _, b in rows if v < 3}


def test_windows_of_large_files(spark, tmp_path):
    r = random.Random(9)
    contents = {f"v {i}#é": bytes(r.choice(b"abcdefgh") for _ in range(n)) for i, n in enumerate((0, 1, 5000, 20000))}
    for name, b in contents.items():
        (tmp_path / name).write_bytes(b)
    whole = corpus.directory(spark, str(tmp_path))
    parts = corpus.windows(spark, str(tmp_path), size=777)
    assert parts.count() == sum(-(-len(b) // 777) for b in contents.values())
    for rule in (segment.SMALL_FASTCDC, segment.SMALL_GEARCDC):
        want = sorted(map(tuple, segment.content_defined(whole, rule).collect()))
        assert sorted(map(tuple, segment.content_defined_windows(parts, rule).collect())) == want


def test_overheads_and_throughput(spark):
    m = spark.createDataFrame([(10, 8, 5)], "logical_chunks long, unique_chunks long, base_chunks long")
    assert tuple(metrics.locality_overhead(m, spark.createDataFrame([(3,)], "names long")).first()) == (320, 576, 240, 36, 80, 1172)
    assert tuple(metrics.tiered_overhead(m, spark.createDataFrame([(7,)], "sf_number long")).first()) == (896, 280, 80, 1176, 7)
    log = spark.createDataFrame([(0, 100, 40, 2.0), (1, 5, 5, 0.0)], "version_no long, logical_bytes long, new_bytes long, seconds double")
    assert sorted(map(tuple, metrics.throughput(log).collect())) == [(0, 2.0, 50.0, 30.0), (1, 0.0, None, None)]


def test_block_delta(spark):
    rows = [(b"a" * 16 + b"b" * 16 + b"tail", b"b" * 16 + b"x"), (b"", b"q"), (b"abc", None), (b"abc", b"")]
    df = spark.createDataFrame(rows, "t binary, b binary")
    assert [r[0] for r in df.select(codec.block_delta_size(F.col("t"), F.col("b"))).collect()] == [4 + 17 + 4 + 5, 4, None, 8]


@pytest.mark.parametrize("hits", [1, 60, 1 << 20])
def test_smallest_deltas_by_brute_force(monkeypatch, hits):
    monkeypatch.setattr(smallest, "HITS", hits)
    r = random.Random(hits)
    for _ in range(10):
        parts = [bytes(r.choice(b"abcd ") for _ in range(r.randrange(1, 30))) for _ in range(12)]
        rows = sorted((r.randrange(3), i, b"".join(r.choice(parts) for _ in range(r.randrange(14)))[: r.choice([5, 20, 100, 400])]) for i in range(50))
        columns = [list(x) for x in zip(*rows, strict=True)]
        got = {c: (d, base) for c, d, base in zip(*smallest.Bases(*columns).smallest(*columns), strict=True)}
        want = {c: min(((len(codec.encode(t, b)), base) for h, base, b in rows if h == g and base < c), default=None) for g, c, t in rows}
        assert got == {c: x for c, x in want.items() if x is not None}


@pytest.mark.parametrize("slab, deal", [(32 << 20, 8 << 20), (2000, 500), (1, 1)])
def test_all_candidates_in_slabs(spark, featureless, monkeypatch, slab, deal):
    """No pair is a row: bases in slabs of ids, targets dealt over cells."""
    monkeypatch.setattr(reduce, "SLAB", slab)
    monkeypatch.setattr(reduce, "DEAL", deal)
    far = featureless.withColumn("chunk_id", F.col("chunk_id") * 1500)  # several parts of ids
    sf = super_features(far)
    want = sorted(map(tuple, reduce.by_candidates(far, index.all_matches(sf)).collect()))
    assert sorted(map(tuple, reduce.by_all(far, sf).collect())) == want and any(r[2] is not None for r in want)
