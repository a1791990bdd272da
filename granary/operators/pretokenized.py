"""Pre-tokenized blocks: a dataset as token arrays per field, with access to single fields and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.tokens import fingerprint, tokens
from granary.operators.dataset import ORDER, melt, ordered

GROUP = 4096  # rows whose tokens of a field are one array


def write_block(df: DataFrame, order: list[str], path: str, encoding: str = "o200k_base", group: int = GROUP) -> None:
    """Per field and group of rows one array of tokens and the places where rows begin in it; a null cell is a null place.

    Files are partitioned by field, so that reading a field reads nothing else; a distinct text is tokenized once in each group.
    """
    rows = ordered(df, *order).select(ORDER, *[F.col(f"`{c}`") for c in df.columns if c not in order])
    cells = melt(rows, [ORDER]).select("field", (F.col(ORDER) % group).cast("int").alias("k"), F.floor(F.col(ORDER) / group).alias("block"), "value")
    ids = cells.filter("value is not null").select("field", "block", "value").distinct().withColumn("ids", tokens(F.col("value"), encoding))
    made = cells.join(ids, ["field", "block", "value"], "left").groupBy("field", "block").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("rows"))
    sizes = F.transform("rows", lambda r: F.coalesce(F.size(r["ids"]), F.lit(0)))
    begin = F.slice(F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))), F.lit(1), F.size("rows"))
    places = F.zip_with("rows", begin, lambda r, b: F.when(r["ids"].isNotNull(), b))
    flat = F.flatten(F.transform("rows", lambda r: F.coalesce(r["ids"], F.array().cast("array<int>"))))
    made = made.select("field", "block", F.lit(encoding).alias("encoding"), F.lit(fingerprint(encoding)).alias("fingerprint"), flat.alias("tokens"), places.alias("begin"))
    made.write.partitionBy("field").parquet(path)


def read_block(spark: SparkSession, path: str, field: str | None = None, first: int = 0, n: int | None = None, group: int = GROUP) -> DataFrame:
    """field, row, tokens (null for null cells) of a block, or of one field and n rows of it from ``first``."""
    df = spark.read.parquet(path)
    if field is not None:
        df = df.filter(F.col("field") == field)
    if n is not None:
        df = df.filter((F.col("block") >= first // group) & (F.col("block") <= (first + n - 1) // group))
    rows = df.select("field", "block", "tokens", "begin", F.posexplode("begin").alias("k", "at"))
    later = F.filter(F.slice("begin", F.col("k") + 2, F.size("begin")), lambda x: x.isNotNull())
    end = F.coalesce(F.get(later, F.lit(0)), F.size("tokens"))
    own = F.when(F.col("at").isNotNull(), F.slice("tokens", F.col("at") + 1, end - F.col("at")))
    out = rows.select("field", (F.col("block") * group + F.col("k")).alias("row"), own.alias("tokens"))
    return out if n is None else out.filter((F.col("row") >= first) & (F.col("row") < first + n))
