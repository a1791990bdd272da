"""Byte-pair tokens in Arrow-batched functions; encodings are rank files, read once per Python worker."""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encoding names that a user may ask for, and the installed rank file each is served by.
ENCODINGS: dict[str, str] = {
    "byte_bpe_50k": "byte_bpe_50k.tiktoken",
    "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken",
    "o200k_base": "byte_bpe_multi_50k.tiktoken",
    "cl100k_base": "byte_bpe_50k.tiktoken",
    "p50k_base": "byte_bpe_50k.tiktoken",
    "r50k_base": "byte_bpe_50k.tiktoken",
}
PROBES = ("hello world", '{"id":1}', "naïve café", "\t\n", "1234567890")
FORMAT_VERSION = "1"


def register_encoding(name: str, rank_file: str) -> None:
    ENCODINGS[name] = rank_file


@cache
def encoder(rank_file: str):
    import os

    import public_tokenizers
    import tiktoken

    place = rank_file if os.path.isabs(rank_file) else public_tokenizers.path(rank_file)
    with open(place, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(rank_file), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, encoding: str = "o200k_base") -> list[int]:
    return encoder(ENCODINGS[encoding]).encode_ordinary(text)


def decode_tokens(ids: list[int], encoding: str = "o200k_base") -> str:
    return encoder(ENCODINGS[encoding]).decode(ids)


@cache
def fingerprint(encoding: str) -> str:
    """A hash of what the encoder makes of a few probes, to notice another rank file under the same name."""
    ids = [i for p in PROBES for i in encode_text(p, encoding)]
    return hashlib.sha256(struct.pack(f"<{len(ids)}i", *ids) + FORMAT_VERSION.encode()).hexdigest()


def tokens(text: Column, encoding: str = "o200k_base") -> Column:
    rank_file = ENCODINGS[encoding]

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        e = encoder(rank_file)
        return s.map(lambda t: None if t is None else e.encode_ordinary(t))

    return run(text)


def token_count(text: Column, encoding: str = "o200k_base") -> Column:
    rank_file = ENCODINGS[encoding]

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        e = encoder(rank_file)
        return s.map(lambda t: 0 if t is None else len(e.encode_ordinary(t)))

    return run(text)


def detokenized(ids: Column, encoding: str = "o200k_base") -> Column:
    rank_file = ENCODINGS[encoding]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        e = encoder(rank_file)
        return s.map(lambda t: None if t is None else e.decode([int(i) for i in t]))

    return run(ids)


def register_sql(spark: SparkSession, encoding: str = "o200k_base") -> None:
    """n_tokens(text) in SQL."""
    rank_file = ENCODINGS[encoding]

    @F.pandas_udf("long")
    def n_tokens(s: pd.Series) -> pd.Series:
        e = encoder(rank_file)
        return s.map(lambda t: 0 if t is None else len(e.encode_ordinary(t)))

    spark.udf.register("n_tokens", n_tokens)


def spread(df: DataFrame, text: str, encodings: list[str]) -> DataFrame:
    """encoding, tokens: what each encoding needs for all texts."""
    out = df.select(*[token_count(F.col(text), e).alias(e) for e in encodings]).agg(*[F.sum(e).alias(e) for e in encodings])
    return out.unpivot([], encodings, "encoding", "tokens")


def repeated_share(df: DataFrame, text: str, encoding: str = "o200k_base") -> DataFrame:
    """The share of tokens whose id stands more than once."""
    ids = df.select(F.explode(tokens(F.col(text), encoding)).alias("id")).groupBy("id").count()
    return ids.agg(F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)), F.sum("count")), F.lit(0.0)), 4).alias("repeated"))
