"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network with
temperature-calibrated probabilities.

Words (runs of letters, digits or signs) fall into BUCKETS by hash. Each bucket has a sparse random index of +1 and
-1; a word's vector is the sum of the indexes of the words up to WINDOW places away, over all documents, in whole
numbers, so that its size is fixed and reruns agree. A document is the mean and the spread of its words' unit vectors.

The network is fitted on the driver on at most SAMPLE labelled rows, those of smallest hash; a fifth of them sets the
temperature, or all of them where they are fewer than APART. Everything else covers all rows. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts pool to zeros and get the network's score for that; labels that contradict each
other are averaged, ties count as 1, null labels are ignored; with labels of one class or none, every score is that
class's share (0.5 without labels); repeated rows repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import lean, sliced

BUCKETS, DIMS, WINDOW = 1 << 15, 32, 2
SAMPLE, HIDDEN, EPOCHS, SEED = 20_000, 32, 60, 11
APART, DECAY = 50, 1e-4
CHUNKS = 64
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def random_index() -> tuple[np.ndarray, np.ndarray]:
    """Places of the +1 and of the -1 in each bucket's index; they differ."""
    r = np.random.default_rng(SEED)
    plus = r.integers(0, DIMS, BUCKETS)
    return plus, (plus + r.integers(1, DIMS, BUCKETS)) % DIMS


class Tokens:
    """Bucket numbers of a text's words; the table of words seen is bounded."""

    KEEP = 300_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> list[int]:
        words, known = WORD.findall(text), self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > self.KEEP:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
            return [known[w] for w in words]

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All buckets, and where each text's end."""
        each = [np.array(self(t), np.int32) if t else np.empty(0, np.int32) for t in texts]
        return (np.concatenate(each) if each else np.empty(0, np.int32)), np.cumsum([len(x) for x in each], dtype=np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS unit vectors (zeros for buckets without words), from all rows."""
    plus, minus = random_index()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = Tokens(), np.zeros(BUCKETS * DIMS, np.int64)
        for whole in batches:
            for batch in sliced(whole, "text"):
                ids, ends = tokens.flat(batch.column("text").to_pylist())
                owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                for gap in range(1, WINDOW + 1):
                    if len(ids) <= gap:
                        continue
                    same = owner[gap:] == owner[:-gap]
                    left, right = ids[:-gap][same].astype(np.int64), ids[gap:][same].astype(np.int64)
                    for centre, context in ((left, right), (right, left)):
                        total += np.bincount(centre * DIMS + plus[context], minlength=BUCKETS * DIMS)
                        total -= np.bincount(centre * DIMS + minus[context], minlength=BUCKETS * DIMS)
        parts = total.reshape(CHUNKS, -1)
        some = [i for i in range(CHUNKS) if parts[i].any()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(some, pa.int32()), "sums": pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "sums": pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())})

    shape = "chunk int, sums binary"
    found = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(lean(count), shape).repartition(12, "chunk").mapInArrow(lean(add), shape).collect()
    out = np.zeros((CHUNKS, BUCKETS * DIMS // CHUNKS), np.int64)
    for r in found:  # CHUNKS rows of fixed size
        out[r["chunk"]] = np.frombuffer(zlib.decompress(bytes(r["sums"])), np.int64)
    v = out.reshape(BUCKETS, DIMS).astype(np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(vectors: np.ndarray, tokens: Tokens, texts: list[str | None]) -> np.ndarray:
    """Mean and spread of the word vectors of each text, 2 * DIMS columns."""
    ids, ends = tokens.flat(texts)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    sums, squares = np.zeros((len(texts), DIMS)), np.zeros((len(texts), DIMS))
    step = 1 << 16
    for start in range(0, len(ids), step):
        stop = min(start + step, len(ids))
        rows = vectors[ids[start:stop]]
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
        own = np.arange(first, last + 1)
        own = own[ends[own] > begins[own]]
        cuts = np.maximum(begins[own], start) - start
        sums[own] += np.add.reduceat(rows, cuts, axis=0, dtype=np.float64)
        squares[own] += np.add.reduceat(rows * rows, cuts, axis=0, dtype=np.float64)
    n = np.maximum(ends - begins, 1)[:, None]
    mean = sums / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0))], axis=1)


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def gradients(params: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss and half of DECAY times the squared weights: w1, b1, w2, b2."""
    h = np.tanh(a @ params[0] + params[1])
    p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -500, 500)))
    g = (p - b) / len(b)
    gh = np.outer(g, params[2]) * (1 - h * h)
    return [a.T @ gh + DECAY * params[0], gh.sum(axis=0), h.T @ g + DECAY * params[2], np.array([g.sum()])]


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    r = np.random.default_rng(seed)
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    order = r.permutation(len(y))
    apart, own = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= APART else (order, order)
    xs, ys = x[own], y[own]
    net = Network(xs.mean(axis=0), xs.std(axis=0) + 1e-6, r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (xs - net.centre) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(EPOCHS, min(1000, 20_000 // max(1, len(ys) // 256 + 1)))):
        for part in np.array_split(r.permutation(len(ys)), max(1, len(ys) // 256)):
            step += 1
            for i, q in enumerate(gradients(params, z[part], ys[part])):
                m[i] = 0.9 * m[i] + 0.1 * q
                v[i] = 0.999 * v[i] + 0.001 * q * q
                params[i] -= 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(net.centre, net.scale, params[0], params[1], params[2], float(params[3][0]))
    logits, want = net.logits(x[apart]), y[apart]

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, logits / t) - want * logits / t))

    net.temperature = float(min(np.geomspace(0.25, 8, 71), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network fitted on labelled rows that are not held out."""
    vectors = word_vectors(docs)
    known = labels.select(labels["doc_id"].cast("long").alias("_id"), labels[target].cast("double").alias("_y")).where("_id is not null and _y is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.avg("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for whole in batches:
            for batch in sliced(whole, "text"):
                x = pool(vectors, tokens, batch.column("text").to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": pa.array([a.tobytes() for a in x], pa.binary())})

    few = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    few = few.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("_y").alias("y"), "text")  # at most `sample` ids
    rows = few.mapInArrow(lean(pooled), "doc_id long, y double, x binary").orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(sample).toPandas().sort_values(["doc_id", "x"])
    x = np.array([np.frombuffer(b, np.float32) for b in rows["x"]], np.float64).reshape(-1, 2 * DIMS)
    return vectors, fit(x, (rows["y"].to_numpy() >= 0.5).astype(np.float64))


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for whole in batches:
            for batch in sliced(whole, "text"):
                p = net.scores(pool(vectors, tokens, batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(p, pa.float64())})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, *train(docs, labels, target))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    vectors, net = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for whole in batches:
            for batch in sliced(whole, "text"):
                good = net.scores(pool(vectors, tokens, batch.column("text").to_pylist())) >= threshold
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(lean(run), docs.schema)
