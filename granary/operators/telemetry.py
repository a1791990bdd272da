"""Cache telemetry, run snapshots and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cache_summary(records: DataFrame) -> DataFrame:
    """Totals, hits, misses and latencies of records (ts, operation, hit, reason, latency); percentiles by nearest rank below."""
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("hit"), 1)).alias("hits"),
        F.count(F.when(~F.col("hit"), 1)).alias("misses"),
        F.round(F.avg(F.when(F.col("hit"), 100.0).otherwise(0.0)), 6).alias("hit_pct"),
        F.round(F.avg("latency"), 6).alias("avg_latency"),
        F.min("ts").alias("since"),
    )


def counts_by(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("hits"))


def latency_percentiles(records: DataFrame, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """p, latency: the value at place min(floor(n p), n - 1) in sorted order.

    Latencies are counted by value first, so that the running count goes over distinct values.
    """
    counts = records.filter("latency is not null").groupBy("latency").agg(F.count(F.lit(1)).alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy("latency")))
    total = counts.agg(F.sum("c").alias("n"))
    want = total.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("place")) for p in ps])).alias("w")).select("w.p", "w.place")
    return run.join(F.broadcast(want), F.col("upto") > F.col("place")).groupBy("p").agg(F.min("latency").alias("latency"))


def record_filter(records: DataFrame, operation=None, hit=None, reason=None, key=None, since=None) -> DataFrame:
    cond: Column = F.lit(True)
    for name, v in (("operation", operation), ("hit", hit), ("reason", reason), ("key", key)):
        if v is not None:
            cond = cond & (F.col(name) == v)
    if since is not None:
        cond = cond & (F.col("ts") >= since)
    return records.filter(cond)


def last_records(records: DataFrame, n: int = 10_000) -> DataFrame:
    return records.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key; the largest order wins."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return last.select("r.*")


def previous_delta(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each row with the previous value of its key and the difference."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("previous"))


def delta_text(d: Column) -> Column:
    return F.when(d.isNull(), "n/a").when(d > 0, F.concat(F.lit("+"), F.format_number(d, 2))).otherwise(F.format_number(d, 2))


def scorecard(runs: DataFrame, floor: float = 35, median: float = 60, datasets: int = 3) -> DataFrame:
    """Latest run per input (input, ts, id, reduction): the smallest and the median reduction, and whether they pass."""
    last = latest_per_key(runs, "input", [F.col("ts"), F.col("id")])
    g = last.agg(F.count(F.lit(1)).alias("datasets"), F.min("reduction").alias("floor"), F.median("reduction").alias("median"))
    return g.withColumn("passed", (F.col("floor") >= floor) & (F.col("median") >= median) & (F.col("datasets") >= datasets))


def efficiency(mb_per_s: Column, ratio: Column, latency_points: Column, heap_points: Column) -> Column:
    return F.least(F.lit(30.0), mb_per_s / 10 * 30) + F.least(F.lit(30.0), (1 - ratio) / 0.6 * 30) + latency_points + heap_points


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 65, "B").when(score >= 40, "C").otherwise("D")
