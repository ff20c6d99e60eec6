"""Every reduction method against a plain pass over all chunks in order, which tries each candidate's delta anew."""

import io
import random
import tarfile

import pytest

from chunkloom.functions import features as ft
from chunkloom.operators import codec, reduce
from chunkloom.operators.dedup import PLACE
from chunkloom.operators.pipeline import POLICIES, ReductionPipeline

FILES = "version_no int, file_id long, path string, content binary"
MASK = 2**64 - 1


def versions(seed=3, n=14):
    r = random.Random(seed)
    say = lambda k: bytes(r.choice(b"abcdefghijk lmnop\n") for _ in range(k))
    base, out = say(2500), []
    for v in range(n):
        b = bytearray(base)
        for _ in range(r.randint(0, 8)):
            at = r.randrange(len(b))
            b[at : at + r.randint(0, 30)] = say(r.randint(0, 40))
        if v % 3 == 2:
            base = bytes(b)
        out.append((v // 2, v, f"v{v // 2}", bytes(b) + b"same tail " * 30 + (say(400) if v % 4 else b"")))
    return out


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(versions(), FILES).cache()


def groups(f, size):
    return [tuple(f[i : i + size]) for i in range(0, 12, size)]


def keys(method, data, gate):
    """[(position, value)] in order of positions."""
    if method == "ntransform":
        f = ft.ntransform(data)
        return [(i, (i, f[i], f[3 + i], f[6 + i], f[9 + i])) for i in range(3)]
    if method == "finesse":
        f = ft.finesse(data)
        ranked = [sorted(f[3 * g : 3 * g + 3]) for g in range(4)]
        return [(i, (i, *(g[i] for g in ranked))) for i in range(3)]
    f = ft.odess([data])[0].tolist()
    if method == "palantir":
        return [(t * 10 + i, (t, *x)) for t, size in ((1, 4), (2, 3), (3, 2)) for i, x in enumerate(groups(f, size))]
    return list(enumerate(groups(f, 4))) if len(data) > gate else []


def samples(data):
    gear, h, out = ft.gear64().tolist(), 0, []
    for b in data:
        h = ((h << 1) + gear[b]) & MASK
        if not h & ft.SAMPLE_MASK:
            out.append(h)
    return out


class Plain:
    """One pass in order. rows: (chunk_id, version, data or None for a repeat, name)."""

    def __init__(self, method, threshold=None):
        self.m, self.threshold, self.out = method, threshold, {}
        self.data, self.up, self.kids, self.index, self.names, self.wins, self.added = {}, {}, {}, {}, {}, {}, {}

    def size(self, chunk, base):
        return len(codec.encode(self.data[chunk], self.data[base]))

    def chain(self, c):
        return [*self.chain(self.up[c]), c] if c in self.up else [c]

    def earlier(self, sfs, version):
        """Inserts under the first value with any, in order."""
        for pos, k in sfs:
            seen = self.index.get(k, [])
            if self.m == "palantir":
                keep = {2: 6, 3: 3}.get(pos // 10)
                seen = seen[-1:] if seen and (keep is None or version - seen[-1][1] <= keep) else []
            if seen:
                return k, [c for c, _ in seen]
        return None, []

    def averages(self):
        bases = [d for d in self.out.values() if d[1] is None]
        deltas = [d for d in self.out.values() if d[1] is not None]
        raw, small = sum(d[2] for d in bases), sum(d[3] for d in bases)
        return (raw / small if small else None), deltas, bases

    def pick(self, chunk, sfs, seen, key):
        """(base, content to encode against, or None for the base's own)"""
        m = self.m
        if m in ("mibl", "odess", "palantir", "ntransform", "finesse"):
            return seen[-1], None
        if m == "log2":
            return seen[0 if len(seen) == 1 else 2 ** ((len(seen) - 1).bit_length() - 1)], None
        if m == "less4":
            return seen[min(len(seen) - 1, 4)], None
        if m == "all_greedy":
            return min(set(seen), key=lambda c: (self.size(chunk, c), c)), None
        if m == "midf":
            line = self.chain(seen[-1])
            return seen[-1], self.data[line[0]] + b"".join(self.added[c] for c in line[1:])
        if m == "mibl2":
            return min(self.chain(seen[-1]), key=lambda c: self.size(chunk, c)), None
        if m == "mibl3":
            own = set(samples(self.data[chunk]))
            return max(self.chain(seen[-1]), key=lambda c: sum(x in own for x in samples(self.data[c]))), None
        best = seen[0]
        if m == "tree_greedy":
            level = [best]
            while level:
                level = [c for x in level for c in self.kids.get(x, [])]
                for c in level:
                    if self.size(chunk, c) < self.size(chunk, best):
                        best = c
            return best, None
        while True:  # tree_cut, tree_layer
            father = best
            for c in self.kids.get(father, []):
                if self.size(chunk, c) < self.size(chunk, best):
                    best = c
            if best == father:
                return best, None
            if m == "tree_layer":
                last, n = self.wins.get(father, (None, 0))
                self.wins[father] = (best, n + 1 if last == best else 1)
                if self.wins[father][1] > 4:
                    first = next(k for _, k in sfs if k in self.index)
                    self.index[first] = [(best, 0), *self.index[first][1:]]

    def found(self, chunk, version, data, name, sfs):
        """(kind, base, save) of a delta, or None."""
        key, seen = self.earlier(sfs, version)
        ratio, deltas, bases = self.averages()
        if self.m == "bisearch":
            hit = seen[-1] if seen else None
            local = self.names.get(name) if version > 0 and name is not None else None
            if local is not None:
                d = self.size(chunk, local)
                bar = self.threshold
                if bar is None and deltas:
                    bar = ratio + sum(x[2] // x[3] for x in deltas) / len(deltas) * (len(deltas) // len(bases)) / 10
                if d <= len(data) and (hit == local or bar is None or bar <= len(data) // d):
                    return "LOCAL_DELTA", local, d
            if hit is not None and self.size(chunk, hit) <= len(data):
                return "FEATURE_DELTA", hit, self.size(chunk, hit)
            return None
        if not seen or self.m == "dedup":
            return None
        base, content = self.pick(chunk, sfs, seen, key)
        delta = codec.encode(data, self.data[base] if content is None else content)
        ok = len(delta) <= len(data)
        if self.m in ("ntransform", "finesse"):
            ok = True
        if self.m == "palantir":
            ok = len(data) / len(delta) >= (2 if ratio is None else ratio)
        if ok:
            self.added[chunk] = codec.literals(delta)
        return ("FEATURE_DELTA" if self.m == "finesse" else "DELTA", base, len(delta)) if ok else None

    def run(self, rows):
        gate = -1 if self.m == "bisearch" else ft.MIN_SIZE
        bases_only = self.m in ("odess", "palantir", "ntransform", "finesse", "bisearch")
        for chunk, version, data, name in rows:
            sfs = keys(self.m, self.data[chunk] if data is None else data, gate)
            if data is None:
                if self.m == "palantir" and chunk not in self.up:
                    for _, k in sfs:
                        self.index[k] = [(chunk, version)]
                continue
            self.data[chunk] = data
            got = self.found(chunk, version, data, name, sfs)
            if got is None:
                save = codec.lz4_size(data)
                got = "BASE_LZ4" if save < len(data) else "BASE_RAW", None, save
                self.names[name] = chunk
            else:
                self.up[chunk] = got[1]
                self.kids.setdefault(got[1], []).append(chunk)
            self.out[chunk] = got[0], got[1], len(data), got[2]
            if got[1] is None or not bases_only:
                for _, k in sfs:
                    self.index.setdefault(k, []).append((chunk, version))
        return self.out


def stream(out, names):
    """Logical chunks in order of place; only the first of a content has its data."""
    ids = {r["fp"]: r["chunk_id"] for r in out["unique"].collect()}
    seen, rows = set(), []
    for r in sorted(out["chunks"].collect(), key=lambda r: tuple(r[x] for x in PLACE)):
        c = ids[r["fp"]]
        rows.append((c, r["version_no"], None if c in seen else bytes(r["payload"]), names(r)))
        seen.add(c)
    return rows


def decided(out):
    return {r["chunk_id"]: (r["kind"], r["base_id"], r["chunk_size"], r["save_size"]) for r in out["decisions"].collect()}


@pytest.mark.parametrize("method", ["dedup", *POLICIES, *(m for m in reduce.METHODS if m != "tree_cache")])
def test_method_equals_a_plain_pass(files, method):
    out = ReductionPipeline("small_fastcdc", method).run(files)
    want = Plain(method).run(stream(out, lambda r: str(r["file_id"])))
    assert decided(out) == want
    deltas = [d for d in want.values() if d[1] is not None]
    assert bool(deltas) == (method != "dedup")


def archives(seed=5):
    r, out = random.Random(seed), []
    bodies = {f"dir/{i}.txt": bytes(r.choice(b"abcdefgh \n") for _ in range(r.randint(300, 1500))) for i in range(8)} | {"long/" + "n" * 120: b"body of a long name " * 40}
    for v in range(5):
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w", format=tarfile.GNU_FORMAT) as t:
            for name, b in bodies.items():
                info = tarfile.TarInfo(f"v{v}/{name}")
                info.size = len(b)
                t.addfile(info, io.BytesIO(b))
        out.append((v, v, f"v{v}", buffer.getvalue()))
        for name in r.sample(sorted(bodies), 4):
            b = bytearray(bodies[name])
            at = r.randrange(len(b))
            b[at : at + 3] = bytes(r.choice(b"xyz") for _ in range(r.choice([1, 40, 600])))
            bodies[name] = bytes(b)
    return out


@pytest.mark.parametrize("threshold, locality", [(None, True), (3, True), (None, False)])
def test_locality_of_members(spark, threshold, locality):
    rows = archives()
    out = ReductionPipeline("tar", "bisearch", threshold=threshold, locality=locality).run(spark.createDataFrame(rows, FILES))
    name = lambda r: "/".join(("header" if r["kind"] == "header" else "body", r["name"].split("/", 1)[-1])) if locality else None
    want = Plain("bisearch", threshold).run(stream(out, name))
    assert decided(out) == want
    assert any(d[0] == "LOCAL_DELTA" for d in want.values()) == locality
