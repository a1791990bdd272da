"""Whether a decoded dataset still says what the original said: row counts, field paths and rows, matched one to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalar import to_text
from granary.operators.dataset import leaves, path, row_anchor

LEAST = 95.0


def told(df: DataFrame) -> DataFrame:
    """anchor, pairs, leaves: each row's anchor (see row_anchor; null without one), the sorted set of its leaves with values, and that set's SHA-256.

    The hash is told to be never null, so that a join on it infers no filter. Such a filter would go below the columns'
    own expressions, and Spark would list it in all ways of writing some of them by name: 2 to the number of columns.
    """
    found = sorted(leaves(df.schema), key=lambda x: f"{x[0]}=".encode())
    cells = [F.when(path(name).isNotNull(), F.concat(F.lit(name + "="), to_text(path(name), kind))) for name, kind in found]
    rows = df.select(row_anchor(df).alias("anchor"), F.filter(F.array(*cells), lambda x: x.isNotNull()).alias("pairs"))
    return rows.withColumn("leaves", F.coalesce(F.unhex(F.sha2(F.to_json("pairs"), 256)), F.lit(b"")))


def matched_rows(original: DataFrame, decoded: DataFrame, least: float = LEAST) -> DataFrame:
    """rows, decoded_rows, matched: rows of the original that find a partner of their own.

    Rows are counted by kind first, under the hash of their leaves. Equal leaves match directly, as often as both
    sides have them; the kinds that are left get their leaves back and find, among rows of the same anchor, the
    one that shares most of their leaves, ``least`` percent at the least. Partners that want each other are taken
    together, round by round, until none are left. Only kinds meet, not rows. All joins sort both sides: what
    is known of sizes beforehand is the scan's, and a table that looks small from there must not go to the driver.
    """
    spark = original.sparkSession
    kept = lambda df: df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()
    side = lambda df, one: told(df).select("leaves", F.lit(one).alias("n1"), F.lit(1 - one).alias("n2"))
    kinds = kept(side(original, 1).unionAll(side(decoded, 0)).groupBy("leaves").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")))
    rows, decoded_rows, matched = kinds.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n1", "n2", F.least("n1", "n2"))]).first()

    def left(df: DataFrame, n: str, other: str) -> DataFrame:
        more = kinds.filter(F.col(n) > F.col(other)).select("leaves", (F.col(n) - F.col(other)).alias(n))
        found = told(df).filter("anchor is not null").join(more.hint("merge"), "leaves").dropDuplicates(["leaves"])
        return found.select("anchor", F.col("pairs").alias(f"p{n[1]}"), F.sha2(F.to_json(F.struct("anchor", "pairs")), 256).alias(f"k{n[1]}"), n)

    shared, size = F.size(F.array_intersect("p1", "p2")), F.size("p1")
    score = left(original, "n1", "n2").join(left(decoded, "n2", "n1").hint("merge"), "anchor").filter(shared * 100 >= size * least)
    score = score.select("k1", "k2", "n1", "n2", (shared / size).alias("share"))
    while True:
        score = kept(score)
        best = lambda k, other: F.row_number().over(Window.partitionBy(k).orderBy(F.col("share").desc(), other)) == 1
        mutual = score.withColumn("x", best("k1", "k2")).withColumn("y", best("k2", "k1")).filter("x AND y").select("k1", "k2", F.least("n1", "n2").alias("took"))
        got = mutual.agg(F.coalesce(F.sum("took"), F.lit(0))).first()[0]
        if not got:
            break
        matched += got
        minus = lambda df, k, n: df.join(mutual.groupBy(k).agg(F.sum("took").alias("t")).hint("merge"), k, "left").withColumn(n, F.col(n) - F.coalesce("t", F.lit(0))).drop("t")
        score = minus(minus(score, "k1", "n1"), "k2", "n2").filter("n1 > 0 AND n2 > 0")
    return spark.createDataFrame([(int(rows), int(decoded_rows), int(matched))], "rows long, decoded_rows long, matched long")


def field_paths(df: DataFrame) -> DataFrame:
    """p: the distinct fields that have a value in some row; one aggregation."""
    found = leaves(df.schema)
    there = df.agg(*[F.count(to_text(path(name), kind)).alias(str(k)) for k, (name, kind) in enumerate(found)])
    each = F.array(*[F.when(F.col(str(k)) > 0, F.lit(name)) for k, (name, _) in enumerate(found)])
    return there.select(F.explode(each).alias("p")).filter("p is not null").distinct()


def semantic_guard(original: DataFrame, decoded: DataFrame, stable: Column | None = None, least: float = LEAST) -> DataFrame:
    """rows, decoded_rows, path_pct, match_pct, passed, reason: the first check that fails. stable: whether the content hash is."""
    from granary.operators.stats import path_overlap

    paths = path_overlap(field_paths(original), field_paths(decoded))
    g = matched_rows(original, decoded, least).crossJoin(paths)
    share = lambda part, whole: F.when(F.col(whole) == 0, 100.0).otherwise(F.col(part) * 100.0 / F.col(whole))
    g = g.withColumn("path_pct", share("covered", "paths")).withColumn("match_pct", share("matched", "rows")).withColumn("stable", stable if stable is not None else F.lit(True))
    reason = F.when(F.col("rows") != F.col("decoded_rows"), "row count").when(F.col("path_pct") < least, "field paths").when(F.col("match_pct") < least, "rows").when(~F.col("stable"), "hash")
    return g.select("rows", "decoded_rows", F.round("path_pct", 6).alias("path_pct"), F.round("match_pct", 6).alias("match_pct"), reason.isNull().alias("passed"), reason.alias("reason"))
