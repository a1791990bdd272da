"""Near copies among embeddings by p-stable hashing, with exact cosine checks.

Vectors are scaled to length one, where a cosine is a Euclidean distance. A table hashes a vector by
``k`` random projections, shifted and cut into cells of a width; vectors that share a cell in all k of
them meet in a bucket. k grows with the logarithm of the rows, so that buckets of unlike vectors stay
small, and the number of tables follows from k, the width and the wanted recall at the threshold.

Equal vectors are one class. A bucket's vectors are compared in blocks, all with all, by matrix
products; blocks send sums of links and a spanning tree, not pairs. A pair counts in the first
table in which it meets, which the buckets in all tables tell that each vector carries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import as_long, lean, mix64, staged, table
from granary.llm.components import components

BLOCK = 2048
ROWS = 512  # of a block that are compared with the whole block at once


def cell_chance(width: float, distance: float) -> float:
    """The chance that two vectors at this distance share a cell of one projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float, recall: float, width: float) -> tuple[int, int]:
    """Projections in a table and number of tables."""
    bits = max(0.5, math.log2(math.sqrt(2 * math.pi * math.e) / width))  # of a cell of a normal variable
    k = max(4, math.ceil((math.log2(max(rows, 2)) + 2) / bits))
    p = cell_chance(width, math.sqrt(2 - 2 * threshold)) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


class Tables:
    """The hash tables for vectors of one dimension."""

    def __init__(self, dims: int, k: int, tables: int, width: float):
        rng = np.random.default_rng([dims, k, tables])
        self.k, self.tables, self.width = k, tables, width
        self.a, self.b = rng.normal(size=(dims, k * tables)), rng.random(k * tables) * width
        self.salts = mix64(np.arange(1, k * tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Hashes, a row per vector and a column per table. Row by row, so that they don't depend on what comes together."""
        cells = np.array([np.floor((v @ self.a + self.b) / self.width) for v in unit]).reshape(len(unit), -1).astype(np.int64).view(np.uint64)
        x = mix64(cells ^ self.salts).reshape(len(unit), self.tables, self.k)
        return mix64(x.sum(axis=2, dtype=np.uint64) + self.salts[:: self.k])


def units(vectors: list) -> np.ndarray:
    """Vectors of one dimension, finite and not zero, scaled to length one in double precision."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked(x: np.ndarray, hashes: np.ndarray, at: int, inside: np.ndarray | None, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of new links of each vector in a bucket of table ``at``, and for each the first vector it is connected with.

    inside: None, or which vectors are of the first of two blocks, of which only pairs across are meant.
    """
    n = len(x)
    hit, links = np.zeros((n, n), bool), np.zeros(n, np.int64)
    for begin in range(0, n, ROWS):
        part = slice(begin, begin + ROWS)
        own = x[part] @ x.T >= threshold
        own[np.arange(len(own)), np.arange(begin, begin + len(own))] = False
        if inside is not None:
            own &= inside[part, None] != inside[None, :]
        hit[part] = own
        for t in range(at):
            own &= hashes[part, t, None] != hashes[None, :, t]
        links[part] = own.astype(np.float64) @ weight
    label = np.arange(n, dtype=np.int32)
    while True:
        low = label.copy()
        for begin in range(0, n, ROWS):
            part = slice(begin, begin + ROWS)
            low[part] = np.minimum(low[part], np.where(hit[part], label[None, :], np.int32(n)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return links, label
        label = low


def near_copies(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.97, width: float = 1.5, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label; other columns are ignored).

    Linked are rows of equal labels whose cosine is found to be at least the threshold. Rows with a
    null label, or whose embedding is null, empty, zero or has a null or non-finite component, are
    linked with nothing. Equal rows are linked with each other. A null vec_id counts as smaller than
    all others, and is given back as null and not kept. An empty table gives an empty one. A vector is
    held whole by its task; its dimension is not bounded. Equal labels and vectors are one class, a number of
    64 bits; if unlike ones shared a number, which a second number shows, all are numbered anew.
    """
    lean(vectors.sparkSession)
    emb = F.col("embedding").cast("array<double>")
    fit = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec"), F.col("label").cast("string").alias("label"), emb.alias("embedding"), fit.alias("fit"))
    for salt in range(1 << 16):
        known = rows.withColumn("class", F.when(F.col("fit"), F.xxhash64(F.lit(salt), "label", "embedding")))
        twin = F.xxhash64(F.lit("twin"), "embedding", "label")
        classes = known.filter("fit").groupBy("class").agg(F.min("vec").alias("vec"), F.max(F.col("vec").isNull()).alias("none"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min(twin).alias("lo"), F.max(twin).alias("hi"))
        classes = staged(classes, "vector-classes")
        if classes.filter("lo <> hi").isEmpty():
            break
    k, tables = plan(classes.count(), threshold, recall, width)

    def hashed(batches):
        made: dict[int, Tables] = {}
        for b in batches:
            for begin in range(0, b.num_rows, 2048):
                part = b.slice(begin, 2048)
                own, labels, embs = (part.column(c).to_pylist() for c in range(3))
                by: dict[int, list[int]] = {}
                for j, e in enumerate(embs):
                    by.setdefault(len(e), []).append(j)
                for dims, js in by.items():
                    t = made.setdefault(dims, Tables(dims, k, tables, width))
                    label = np.array([xxhash.xxh64_intdigest(f"{dims}:{labels[j]}") for j in js], np.uint64)
                    h = mix64(t.buckets(units([embs[j] for j in js])) ^ mix64(label)[:, None])
                    yield pa.record_batch([pa.array([own[j] for j in js], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(js) + 1, dtype=np.int32) * tables), pa.array(as_long(h.reshape(-1))))], ["class", "hashes"])

    hashes = classes.select("class", "label", "embedding").mapInArrow(hashed, "class long, hashes array<long>")
    classes = staged(classes.join(hashes, "class"), "hashed-classes")
    buckets = classes.select("class", F.posexplode("hashes").alias("at", "bucket"))
    several = staged(buckets.groupBy("bucket", "at").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "buckets")
    met = buckets.join(several, ["bucket", "at"])
    met = met.withColumn("blocks", F.ceil(F.col("c") / block)).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("bucket", "at", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class")
    met = met.join(classes.select("class", "weight", "label", "embedding", "hashes"), "class").select("bucket", "at", "i", "j", "own", "class", "weight", "label", "embedding", "hashes")

    def compared(batches):
        key, held = None, []
        out: list[tuple] = []

        def solve():
            kinds: dict[tuple, list] = {}
            for r in held:
                kinds.setdefault((len(r[3]), r[2]), []).append(r)
            for rs in kinds.values():
                if len(rs) < 2:
                    continue
                x = units([r[3] for r in rs])
                inside = None if key[2] == key[3] else np.array([r[4] == key[2] for r in rs])
                links, label = linked(x, np.array([r[5] for r in rs], np.int64), key[1], inside, np.array([r[1] for r in rs], np.int64), threshold)
                for r, n, first in zip(rs, links.tolist(), label.tolist(), strict=True):
                    if n or rs[first][0] != r[0]:
                        out.append((r[0], n, rs[first][0]))

        def batch():
            done = [list(c) for c in zip(*out, strict=True)] or [[], [], []]
            out.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in done], ["class", "links", "first"])

        for b in batches:
            for begin in range(0, b.num_rows, 2048):
                c = [x.to_pylist() for x in b.slice(begin, 2048).columns]
                for bucket, at, i, j, own, cls, weight, label, e, hashes in zip(*c, strict=True):
                    if (bucket, at, i, j) != key:
                        if held:
                            solve()
                        key, held = (bucket, at, i, j), []
                    held.append((cls, weight, label, e, own, hashes))
                if len(out) > 4096:
                    yield batch()
        if held:
            solve()
        yield batch()

    found = met.repartition("bucket", "at", "i", "j").sortWithinPartitions("bucket", "at", "i", "j").mapInArrow(compared, "class long, links long, first long")
    found = staged(found.groupBy("class", "first").agg(F.sum("links").alias("links")), "vector-links")
    together = components(found.select(F.col("class").alias("a"), F.col("first").alias("b")))
    named = classes.select("class", "vec", "none", "weight").join(found.groupBy("class").agg(F.sum("links").alias("links")), "class", "left").join(together.withColumnRenamed("id", "class"), "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    low = named.groupBy("component").agg(F.when(~F.max("none"), F.min("vec")).alias("low"))
    named = staged(named.join(low, "component").select("class", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "low"), "vector-components")
    out = known.select("vec", "class").join(named, "class", "left").withColumn("low", F.when(F.col("class").isNull(), F.col("vec")).otherwise(F.col("low")))
    return out.select(F.col("vec").alias("vec_id"), F.coalesce("n", F.lit(0)).alias("n_links"), F.col("low").alias("component_id"), F.coalesce(F.col("vec") == F.col("low"), F.lit(False)).alias("kept"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))
