"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, staged


SMALL = 1 << 19  # edges that one task joins (8 MB)


def joined(batches):
    """(u, v) of all edges in one task -> (id, component), by hooking labels and halving paths."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate([p[k] for p in parts]) for k in range(2))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.record_batch([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (id, component), component the smallest id reachable; a row per id that has an edge to another.

    Every step is an aggregation and an equi-join over the edges and ends in a table in the shared
    folder; steps are a logarithm of the longest path. The driver sees counts only. Edges that are
    counted to be no more than SMALL are joined by one task instead, with the same result.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = staged(e, "edges")
    if e.count() <= SMALL:
        return e.coalesce(1).mapInArrow(joined, "id long, component long")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        last, e = e, staged(small, "edges")
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
