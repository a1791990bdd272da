"""A corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import new_path, table
from granary.llm.jaccard import one_of_each
from granary.llm.mixing import mixed
from granary.llm.phrases import with_passages_removed
from granary.llm.pieces import encode_documents
from granary.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (shingles of five words, similarity 0.8): that with the smallest doc_id; repeated rows once."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that start earlier are cut, with the blanks behind their words; a document that loses nothing stays as it is."""
    found = with_passages_removed(docs, docs.columns)
    named = {c: F.col(f"carried_{k}") for k, c in enumerate(docs.columns)}
    cut = F.col("n_removed") > 0
    named["text"] = F.when(cut, F.col("rest")).otherwise(named["text"])
    if "n_chars" in named:
        named["n_chars"] = F.when(cut, F.length("rest").cast(docs.schema["n_chars"].dataType)).otherwise(named["n_chars"])
    return found.select(*[v.alias(c) for c, v in named.items()])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with merge-dropout, checked by decoding."""
    return encode_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The scores of the first stage cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
