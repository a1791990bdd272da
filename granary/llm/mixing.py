"""Mixing sources to target weights by Pareto order sampling.

Every source gets a word target: weights over the sources share ``budget`` times all words, no
target exceeds ``ceiling`` times the words of its source, and what a full source cannot take goes
to the others by weight. A source with target T and S words takes floor(T / S) certain whole
copies of each document; the remaining words come from a Pareto order sample: each document draws
a random number u and is ranked by (u / (1 - u)) / odds, odds being its inclusion odds, and the
lowest ranks are taken until the words are filled. The odds of a document are c / sqrt(words) - short
documents are repeated rather than long ones - where c, one factor for a source, makes the expected
words equal the remaining ones; within a source it cancels in the order.

Rows that are equal in doc_id, text and source are one row with a count, of which as many are taken
as the words allow; only the result has a row for each. Running totals over the ranks of a source are
never formed in one task: ranks fall into 1,024 bins, each of 1,024 bins, whose sums are added up;
only the rows of one fine bin meet.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import numbered, staged, table

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 4096  # rows or copies that one input row gives at once


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, ceiling: float) -> DataFrame:
    """(source, size) rows -> (source, source_size, target), a row for each source.

    Targets are min(ceiling * S, level * weight) with one level for all sources. It starts as if no
    source were full and rises as full ones are found, each time by sums over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = numbered(per, F.col("source").asc_nulls_last(), "at", "mix-sources").withColumn("weight", F.element_at(cycle, (F.col("at") % len(weights) + 1).cast("int"))).drop("at")
    full = lambda level: F.lit(float(ceiling)) * F.col("source_size") <= F.lit(float(level)) * F.col("weight")
    total, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, before = (float(budget) * total / weight if weight else 0.0), 0
    while True:
        held, words, weight = per.agg(F.count(F.when(full(level), 1)), F.coalesce(F.sum(F.when(full(level), F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full(level), F.col("weight"))), F.lit(0))).first()
        if held == before or not weight:
            break
        before, level = held, (float(budget) * total - float(ceiling) * words) / weight
    target = F.when(full(level), F.lit(float(ceiling)) * F.col("source_size")).otherwise(F.col("weight") * F.lit(float(level)))
    return per.select("source", "source_size", target.alias("target"))


def factors(sizes: DataFrame) -> DataFrame:
    """(source, size, n, rest) rows, the number of documents of each size -> (source, factor): c of the odds c / sqrt(size), so that the expected words are rest."""

    def solve(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        size, words, rest = rows["size"].to_numpy(float), (rows["size"] * rows["n"]).to_numpy(float), float(rows["rest"].iloc[0])
        low, high = -60.0, 60.0
        for _ in range(100):
            c = np.exp((low + high) / 2)
            low, high = ((low + high) / 2, high) if (words * (c / (c + np.sqrt(size)))).sum() < rest else (low, (low + high) / 2)
        return pd.DataFrame({"source": [key[0]], "factor": [float(np.exp(high)) if rest > 0 else 0.0]})

    return sizes.groupBy("source").applyInPandas(solve, "source string, factor double")


def row_key(docs: DataFrame):
    """A 128-bit hash of what tells rows apart: doc_id, text and source."""
    text = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    parts = [F.coalesce(docs["doc_id"].cast("string"), F.lit("n")), text, F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("n"))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, ceiling: float = 2.0, salt: str = "mix") -> DataFrame:
    """key, doc_id, source, size, n, source_size, target, certain, more, inclusion, a row for each kind of equal rows of docs.

    Each of the n rows is taken ``certain`` times, and ``more`` of them once more. inclusion is the odds'
    probability to be among these.
    """
    size = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(row_key(docs).alias("key"), docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"))
    d = staged(d.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    t = targets(d.select("source", (F.col("size") * F.col("n")).alias("size")), weights, budget, ceiling)
    certain = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = staged(t.withColumn("certain", certain).withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size")), "mix-targets")
    d = d.join(t.withColumnRenamed("source", "s"), d["source"].eqNullSafe(F.col("s"))).drop("s")
    c = staged(factors(d.filter("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))), "mix-factors")
    d = d.join(c.withColumnRenamed("source", "s"), d["source"].eqNullSafe(F.col("s")), "left").drop("s")

    draw = F.conv(F.substring(F.md5(F.concat(F.col("key"), F.lit(":" + salt)).cast("binary")), 1, 13), 16, 10).cast("long")
    u = (draw + F.lit(0.5)) / F.lit(float(2**52))
    d = d.withColumn("rank", u / (1 - u) * F.sqrt(F.greatest(F.col("size"), F.lit(1)).cast("double")))
    place = F.col("rank") / (1 + F.col("rank"))
    d = d.withColumn("fine", F.floor(place * 2**20).cast("long")).withColumn("coarse", F.shiftright("fine", 10))
    d = d.withColumn("own", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))

    fine = d.groupBy("own", "coarse", "fine").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    coarse = fine.groupBy("own", "coarse").agg(F.sum("words").alias("words"))
    before = lambda words, *by, order: F.coalesce(F.sum(words).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select("own", "coarse", before("words", "own", order=["coarse"]).alias("base1"))
    fine = fine.withColumn("base2", before("words", "own", "coarse", order=["fine"])).join(coarse, ["own", "coarse"]).select("own", "fine", (F.col("base1") + F.col("base2")).alias("base"))
    d = d.join(fine, ["own", "fine"]).withColumn("ahead", F.col("base") + before(F.col("size") * F.col("n"), "own", "fine", order=["rank", "key"]))

    room = F.floor((F.col("rest") - F.col("ahead")) / F.col("size") + F.lit(0.5))
    more = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.least(F.greatest(room, F.lit(0)), F.col("n"))).otherwise(0).cast("long")
    inclusion = F.when(F.col("size") > 0, F.col("factor") / (F.col("factor") + F.sqrt(F.col("size").cast("double")))).otherwise(F.lit(0.0))
    return d.select("key", "doc_id", "source", "size", "n", "source_size", "target", "certain", more.alias("more"), inclusion.alias("inclusion"))


def spread(df: DataFrame, times: str, number: str) -> DataFrame:
    """Each row as often as ``times`` says, numbered from 0; a row that gives very many is dealt out in chunks first."""
    last = F.col(times) - 1
    few = df.filter((F.col(times) > 0) & (F.col(times) <= CHUNK)).withColumn("__low", F.lit(0).cast("long")).withColumn("__high", last)
    many = df.filter(F.col(times) > CHUNK).withColumn("__low", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(CHUNK).cast("long"))))
    many = many.withColumn("__high", F.least(F.col("__low") + CHUNK - 1, last)).repartition(F.col("__low"), *([F.col("key")] if "key" in df.columns else []))
    return few.unionByName(many).withColumn(number, F.explode(F.sequence("__low", "__high"))).drop("__low", "__high")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, ceiling: float = 2.0, salt: str = "mix") -> DataFrame:
    """Copies taken of every row of docs (doc_id, text, source; other columns are ignored).

    Returns doc_id, size, source_size, target, copies, taken = size * copies, inclusion (the probability
    of a copy beyond the certain ones). A null text has no words; texts without words take nothing; a
    null source is a source of its own, the last; rows with equal or no doc_ids are told apart by their
    texts, and of equal rows as many are taken once more as the target has room for. An empty table
    gives an empty result; texts are read once, whole, for their size. The random numbers come from
    doc_id, text, source and salt, so that reruns and other partitionings agree.
    """
    rows = spread(plan(docs, weights, budget, ceiling, salt), "n", "j")
    copies = (F.col("certain") + F.when(F.col("j") < F.col("more"), 1).otherwise(0)).cast("long")
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "inclusion")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; rows equal in doc_id, text and source share the columns of one of them."""
    p = plan(docs, **how).filter("size > 0")
    p = staged(p.select(F.col("key").alias("__key"), (F.col("certain") * F.col("n") + F.col("more")).alias("__times")).filter("__times > 0"), "mix-copies")
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(row_key(docs).alias("__key"), *[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)]).dropDuplicates(["__key"])
    rows = spread(rows.join(p, "__key").withColumnRenamed("__key", "key"), "__times", "__copy")
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("inclusion")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat(coalesce(doc_id::VARCHAR, 'n'), ':', md5(coalesce(text, '')), ':', coalesce('s' || source, 'n'))) AS key FROM documents
), g AS (SELECT key, doc_id, source, size, count(*) AS n FROM d GROUP BY ALL
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM d GROUP BY source
), w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
     - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
     / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w
), f AS (SELECT *, 2.0::DOUBLE * source_size <= level * weight AS is_full FROM l
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE weight * (max(CASE WHEN NOT is_full THEN level END) OVER ()) END AS target FROM f
), r AS (
  SELECT g.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain,
    (('0x' || substr(md5(key || ':mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
), o AS (
  SELECT *, target - certain * source_size AS rest, u / (1 - u) * sqrt(greatest(size, 1)::DOUBLE) AS pareto FROM r
), c AS (
  SELECT *, coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY pareto, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS ahead FROM o
), p AS (
  SELECT *, CASE WHEN size > 0 AND rest > 0 THEN least(greatest(floor((rest - ahead) / size + 0.5::DOUBLE), 0), n)::BIGINT ELSE 0 END AS more FROM c
), q AS (SELECT *, unnest(range(n)) AS j FROM p
), z AS (SELECT *, CASE WHEN size > 0 THEN certain + CASE WHEN j < more THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies FROM q
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM z
"""
