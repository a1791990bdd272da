"""The content store: blobs under their hash, written once, and token arrays made from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from granary.errors import NotStoredError
from granary.functions.tokens import fingerprint, tokens

BLOBS = "hash string, body string, rows long, bytes long"
TOKENS = "hash string, model string, encoding string, fingerprint string, tokens array<int>, token_count long"


class ContentStore:
    """Parquet tables blobs and tokens under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def blobs(self) -> DataFrame:
        return self._read("blobs", BLOBS)

    def put(self, bodies: DataFrame) -> DataFrame:
        """Store rows of (body, rows); hash and is_new of each distinct body."""
        new = hashed(bodies)
        known = self.blobs().select("hash", F.lit(True).alias("known"))
        flagged = new.join(known, "hash", "left").withColumn("is_new", F.col("known").isNull()).drop("known")
        answer = f"{self.path}/puts/{uuid.uuid4().hex}"
        flagged.select("hash", "is_new").write.parquet(answer)
        # Which ones are new is read back, so that it is decided once, before they are stored.
        decided = self.spark.read.schema("hash string, is_new boolean").parquet(answer)
        new.join(decided.filter("is_new"), "hash", "left_semi").select("hash", "body", "rows", "bytes").write.mode("append").parquet(f"{self.path}/blobs")
        return decided

    def get(self, hash_: str) -> DataFrame:
        found = self.blobs().filter(F.col("hash") == hash_)
        if found.isEmpty():
            raise NotStoredError(hash_)
        return found

    def has(self, hash_: str) -> bool:
        return not self.blobs().filter(F.col("hash") == hash_).isEmpty()

    def listing(self) -> DataFrame:
        cached = self._read("tokens", TOKENS).groupBy("hash").agg(F.array_sort(F.collect_set("model")).alias("models"))
        return self.blobs().select("hash", "rows", "bytes").join(cached, "hash", "left")

    def materialize(self, model: str, encoding: str = "o200k_base") -> DataFrame:
        """Tokens of every blob, from the cache where the tokenizer is the same, else made and kept."""
        mark = fingerprint(encoding)
        cached = self._read("tokens", TOKENS).filter((F.col("model") == model) & (F.col("encoding") == encoding) & (F.col("fingerprint") == mark))
        missing = self.blobs().join(cached, "hash", "left_anti")
        made = missing.select("hash", F.lit(model).alias("model"), F.lit(encoding).alias("encoding"), F.lit(mark).alias("fingerprint"), tokens(F.col("body"), encoding).alias("tokens"))
        made = made.withColumn("token_count", F.size("tokens").cast("long"))
        if not missing.isEmpty():
            made.write.mode("append").parquet(f"{self.path}/tokens")
        return self._read("tokens", TOKENS).filter((F.col("model") == model) & (F.col("fingerprint") == mark))

    def peek(self, model: str) -> DataFrame:
        """Blobs with their tokens for a model, null where there are none."""
        t = self._read("tokens", TOKENS).filter(F.col("model") == model)
        return self.blobs().select("hash").join(t.select("hash", "token_count"), "hash", "left")


def hashed(bodies: DataFrame) -> DataFrame:
    """hash, body, rows, bytes and copies of each distinct body."""
    b = bodies.select(F.sha2("body", 256).alias("hash"), "body", "rows", F.octet_length("body").cast("long").alias("bytes"))
    return b.groupBy("hash").agg(F.first("body").alias("body"), F.first("rows").alias("rows"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"))


def store_once(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key is not known yet, one per key."""
    return new.join(known.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def row_hash_tree(df: DataFrame, text: str, order: list[str], bits: int = 12) -> DataFrame:
    """A hash of a dataset of any size: rows' hashes, in order, are hashed in blocks of 2^bits rows, then the blocks' hashes."""
    from granary.operators.dataset import ordered

    rows = ordered(df, *order).select(F.shiftright("_ord", bits).alias("block"), "_ord", F.sha2(text, 256).alias("h"))
    blocks = rows.groupBy("block").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return blocks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), ""), 256).alias("hash"))
