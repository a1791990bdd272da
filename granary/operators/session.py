"""Deduplication across batches and sessions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalar import token_estimate


def delta_rows(new: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Rows whose key, as text with null as blank, was not in the previous batch."""
    as_text = lambda df: F.coalesce(df[key].cast("string"), F.lit(""))
    old = previous.select(as_text(previous).alias("__key")).distinct()
    return new.join(old, as_text(new) == old["__key"], "left_anti")


def session_savings(values: DataFrame, schemas: DataFrame, batch: str, cost: Column | None = None) -> DataFrame:
    """Per batch: known schema, new dictionary entries, hits and saved tokens.

    values: (batch, value) texts of the rows; schemas: (batch, signature) of the first row. A text or
    schema is known if an earlier batch had it; a known text saves its tokens but one.
    """
    own = values.filter("value is not null AND value <> ''").select(batch, "value").distinct()
    first = own.groupBy("value").agg(F.min(batch).alias("__first"))
    own = own.join(first, "value").withColumn("known", F.col(batch) > F.col("__first")).drop("__first")
    tokens = cost if cost is not None else token_estimate(F.col("value"))
    v = own.groupBy(batch).agg(
        F.count(F.when(F.col("known"), 1)).alias("dict_hits"),
        F.count(F.when(~F.col("known"), 1)).alias("new_entries"),
        F.sum(F.when(F.col("known"), F.greatest(F.lit(0), tokens - 1)).otherwise(0)).alias("value_saved"),
    )
    # The first batch of each schema, by an aggregation: one schema may have all batches.
    once = schemas.groupBy("signature").agg(F.min(batch).alias("__first"))
    s = schemas.join(once, "signature").withColumn("schema_known", F.col(batch) > F.col("__first")).drop("__first")
    s = s.withColumn("schema_saved", F.when(F.col("schema_known"), token_estimate(F.concat(F.lit("@schema data "), F.replace("signature", F.lit(","), F.lit(" "))))).otherwise(0))
    j = s.join(v, batch, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(batch, "schema_known", zero("dict_hits").alias("dict_hits"), zero("new_entries").alias("new_entries"), (F.col("schema_saved") + zero("value_saved")).alias("saved"))


class SessionState:
    """Schemas and texts seen so far, as two tables; saved under a path and read back."""

    VERSION = 1

    def __init__(self, spark: SparkSession, schemas: DataFrame | None = None, texts: DataFrame | None = None):
        self.spark = spark
        self.schemas = schemas if schemas is not None else spark.createDataFrame([], "signature string, occurrences long")
        self.texts = texts if texts is not None else spark.createDataFrame([], "value string, occurrences long")

    def observe(self, values: DataFrame, signature: str) -> SessionState:
        """The state after a batch of texts (value)."""
        seen = values.filter("value <> ''").select("value").distinct().withColumn("occurrences", F.lit(1).cast("long"))
        texts = self.texts.unionByName(seen).groupBy("value").agg(F.sum("occurrences").alias("occurrences"))
        one = self.spark.createDataFrame([(signature, 1)], "signature string, occurrences long")
        schemas = self.schemas.unionByName(one).groupBy("signature").agg(F.sum("occurrences").alias("occurrences"))
        return SessionState(self.spark, schemas, texts)

    def observe_batches(self, values: DataFrame, schemas: DataFrame, batch: str) -> SessionState:
        """The state after all batches of texts (batch, value) and their schemas (batch, signature), counted in one pass."""
        seen = values.filter("value <> ''").select(batch, "value").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("occurrences"))
        known = schemas.select(batch, "signature").distinct().groupBy("signature").agg(F.count(F.lit(1)).alias("occurrences"))
        merged = lambda old, new, key: old.unionByName(new).groupBy(key).agg(F.sum("occurrences").alias("occurrences"))
        return SessionState(self.spark, merged(self.schemas, known, "signature"), merged(self.texts, seen, "value"))

    def save(self, path: str) -> None:
        self.schemas.write.mode("overwrite").parquet(f"{path}/schemas")
        self.texts.write.mode("overwrite").parquet(f"{path}/texts")
        self.spark.createDataFrame([(json.dumps({"version": self.VERSION}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SessionState:
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        if meta["version"] != cls.VERSION:
            raise ValueError("a state of another version")
        return cls(spark, spark.read.parquet(f"{path}/schemas"), spark.read.parquet(f"{path}/texts"))
