"""Quality classifier: random-indexing word vectors, pooled, and a calibrated two-layer network.

Every word falls into one of ``slots`` hash slots. A slot has a sparse random index vector; over all
documents its context vector sums the index vectors of the words up to two places around it. A
document is the mean and the spread of its words' context vectors. A two-layer numpy network gives
logits, and a temperature fitted on rows kept from training turns them into probabilities.

The context vectors are a table of fixed size, whatever the corpus: tasks send partial sums, which
are added up in a stream, and the driver gets slots x dims numbers once.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import lean, slices, table

TOKEN = re.compile(r"\w+|[^\w\s]+")
SLOTS, DIMS, NONZERO, REACH = 1 << 14, 32, 4, 2
EXTRA = 3  # inputs besides mean and spread
BLOCK = 256  # slots in a row of partial sums
LARGEST_SLOT_CACHE = 100_000


def slot_reader(slots: int):
    """text -> slots of its words; words are looked up in a cache that is emptied when it is full."""
    known: dict[str, int] = {}

    def read(text: str | None) -> np.ndarray:
        if len(known) > LARGEST_SLOT_CACHE:
            known.clear()
        out = []
        for w in TOKEN.findall(text or ""):
            s = known.get(w)
            if s is None:
                s = known[w] = zlib.crc32(w.encode("utf-8", "replace")) % slots
            out.append(s)
        return np.array(out, np.int64)

    return read


def index_vectors(slots: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the nonzero entries of each slot's index vector."""
    rng = np.random.default_rng(11)
    return np.argsort(rng.random((slots, dims)), axis=1)[:, :NONZERO], rng.choice(np.array([-1, 1]), (slots, NONZERO))


def context_vectors(docs: DataFrame, slots: int = SLOTS, dims: int = DIMS) -> np.ndarray:
    """Sums of neighbours' index vectors for each slot, over all documents; exact integers, so independent of partitioning."""

    def partial(batches):
        place, sign = index_vectors(slots, dims)
        read, sums = slot_reader(slots), np.zeros(slots * dims, np.int64)
        for b in slices(batches, 0, 1 << 18):
            parts = [read(x) for x in b.column(0).to_pylist()]
            t = np.concatenate(parts)
            doc = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            for d in range(1, REACH + 1):
                same = doc[d:] == doc[:-d]
                for word, near in ((t[d:][same], t[:-d][same]), (t[:-d][same], t[d:][same])):
                    at = (word[:, None] * dims + place[near]).reshape(-1)
                    sums += np.bincount(at, sign[near].reshape(-1), slots * dims).astype(np.int64)
        yield pa.record_batch([pa.array(range(0, slots, BLOCK), pa.int64()), pa.array([x.tobytes() for x in sums.reshape(-1, BLOCK * dims)], pa.binary())], ["block", "sums"])

    def total(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), np.int64)
                found[k] = found[k] + x if k in found else x.copy()
        yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["block", "sums"])

    kind = "block long, sums binary"
    rows = docs.select(F.col("text").cast("string")).mapInArrow(partial, kind).repartition(8, "block").mapInArrow(total, kind).collect()
    out = np.zeros((slots, dims))
    for r in rows:
        out[r.block : r.block + BLOCK] = np.frombuffer(r.sums, np.int64).reshape(BLOCK, dims)
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return np.divide(context, length, out=np.zeros_like(context), where=length > 0).astype(np.float32)


def pooled(slots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, the number of words, the share of distinct ones and that of words standing twice in a row, as the network's input."""
    n = len(slots)
    if not n:
        return np.zeros(2 * vectors.shape[1] + EXTRA, np.float32)
    own, counts = np.unique(slots, return_counts=True)
    x, w = vectors[own], (counts / n).astype(np.float32)
    mean = w @ x
    return np.concatenate([mean, np.sqrt(np.maximum(w @ (x * x) - mean * mean, 0)), [np.log1p(n), len(own) / n, np.count_nonzero(slots[1:] == slots[:-1]) / n]]).astype(np.float32)


@dataclass
class Network:
    """Two layers over standardised inputs, and a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Row by row, so that no score depends on which rows come together."""
        z = np.array([self.logits(r) for r in np.asarray(x, np.float64)]) / self.temperature
        return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def _loss(z, y):
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(z) else 0.0


def train(x: np.ndarray, y: np.ndarray, keep: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Fit on the rows not in keep, and the temperature on those in keep. With labels of one kind only the prior is learnt."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    rng = np.random.default_rng(7)
    fit = ~keep if (~keep).any() else np.ones(len(x), bool)
    d = x.shape[1]
    centre, scale = (x[fit].mean(0), x[fit].std(0) + 1e-6) if len(x) else (np.zeros(d), np.ones(d))
    prior = (y[fit].sum() + 1) / (fit.sum() + 2)
    net = Network(centre, scale, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(prior / (1 - prior))))
    if len(set(y[fit].tolist())) < 2:
        return net
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    xs, ys = (x[fit] - centre) / scale, y[fit]
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for k in range(0, len(order), 128):
            a, b = xs[order[k : k + 128]], ys[order[k : k + 128]]
            h = np.tanh(a @ params[0] + params[1])
            z = h @ params[2] + params[3]
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - b) / len(b)
            back = np.outer(g, params[2]) * (1 - h * h)
            step += 1
            for j, grad in enumerate((a.T @ back + decay * params[0], back.sum(0), h.T @ g + decay * params[2], np.array([g.sum()]))):
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.999 * v[j] + 0.001 * grad * grad
                params[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if keep.any():
        z, kept = net.logits(x[keep]), y[keep]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        net.temperature = float(grid[int(np.argmin([_loss(z / t, kept) for t in grid]))])
    return net


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents and a network from at most ``sample`` labelled rows outside the held-out fold.

    Labels other than 0 and 1, or null, are not used; of repeated labels the smallest counts, and of
    rows with one doc_id the one with the smallest text hash. No labels at all, or an empty table, give a
    network with a score of one half.
    """
    lean(docs.sparkSession)
    vectors = word_vectors(context_vectors(docs))
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def inputs(batches):
        read, vectors = slot_reader(SLOTS), shared.value
        for b in slices(batches, 1):
            x = [pooled(read(t), vectors).tobytes() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(x, pa.binary()), b.column(2)], ["doc_id", "x", "quality"])

    # At most ``sample`` rows of two numbers are broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # One row of each doc_id: what the driver gets is bounded by ``sample``, however often an id is repeated.
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.select("doc_id", "text", F.col("quality").cast("long")).mapInArrow(inputs, "doc_id long, x binary, quality long").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float32) for r in got]).reshape(len(got), 2 * DIMS + EXTRA)
    keep = np.array([zlib.crc32(b"temperature:%d" % r.doc_id) % 8 == 0 for r in got], bool)
    return vectors, train(x, np.array([r.quality for r in got]), keep)


def score(docs: DataFrame, vectors: np.ndarray, net: Network, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts are scored as texts without words; repeated rows get equal scores, rows without
    a doc_id theirs; an empty table gives an empty one. A text is held whole by its task (2 GB at most).
    """
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def rate(batches):
        read, (vectors, net) = slot_reader(SLOTS), shared.value
        for b in slices(batches, 1):
            p = net.probability(np.array([pooled(read(t), vectors) for t in b.column(1).to_pylist()]))
            yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rate, "doc_id long, score double, predicted int")


def op2_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors, net = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, vectors, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    vectors, net = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def good(batches):
        read, (vectors, net) = slot_reader(SLOTS), shared.value
        for b in slices(batches, 0):
            p = net.probability(np.array([pooled(read(t), vectors) for t in b.column(0).to_pylist()]))
            yield b.filter(pa.array(p >= threshold)).select(list(range(1, b.num_columns)))

    rows = docs.select(F.col("text").cast("string").alias("__text"), *[docs[c] for c in docs.columns])
    return rows.mapInArrow(good, docs.schema)
