"""Verbs over datasets: encode, materialize, compose, savings, prefix reuse, cache readiness, validation."""

from __future__ import annotations

import csv
import io
import json
import logging
import re
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import canonical, record_text, token_stream
from granary.functions import scalar as S
from granary.functions.tokens import decode_tokens, encode_text, token_count, tokens
from granary.operators import budget as B
from granary.operators import dataset as D
from granary.operators import render
from granary.operators.store import ContentStore
from granary.plans.models import MODELS, model, models_table

log = logging.getLogger("granary")


class StoredDataset:
    """A small dataset (rows as Python objects) under its content hash, with tokens per model."""

    def __init__(self, spark: SparkSession, store: ContentStore, rows: list[dict]):
        self.spark, self.store, self.rows = spark, store, rows
        self.blob = canonical.encode(rows)
        self.hash = canonical.content_hash(rows)

    @classmethod
    def encode(cls, spark: SparkSession, store: ContentStore, rows: list[dict]) -> StoredDataset:
        made = cls(spark, store, rows)
        store.put(spark.createDataFrame([(made.to_json(), len(rows))], "body string, rows long"))
        return made

    @classmethod
    def load(cls, spark: SparkSession, store: ContentStore, body_hash: str) -> StoredDataset:
        return cls(spark, store, json.loads(store.get(body_hash).first()["body"]))

    def to_json(self) -> str:
        return json.dumps(canonical.canonical(self.rows), ensure_ascii=False, separators=(",", ":"))

    def to_text(self) -> str:
        return record_text.encode(self.rows)

    def tokens(self, model_name: str, most: int | None = None) -> list[int]:
        """Tokens of the compact text; a limit cuts what is returned, not what is kept."""
        ids = encode_text(compile_rows(self.spark, self.rows), model(model_name)[1])
        return ids[:most] if most else ids

    def token_count(self, model_name: str) -> int:
        return len(self.tokens(model_name))

    def token_binary(self, model_name: str) -> bytes:
        encoding = model(model_name)[1]
        return token_stream.to_binary(token_stream.encode_rows(self.rows, lambda s: encode_text(s, encoding)), encoding)


def frame_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of Python objects as a DataFrame with an order."""
    lines = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "value string")
    df = spark.read.json(lines.rdd.map(lambda r: r.value)) if rows else spark.createDataFrame([], "_ord long")
    return df.withColumn("_ord", F.monotonically_increasing_id()) if rows else df


def compile_rows(spark: SparkSession, rows: list[dict], fmt: str = "compact") -> str:
    if not rows:
        return ""
    return render.document(render.lines(frame_of(spark, rows), fmt, ["_ord"]), ["_ord"]).first()["document"] or ""


def compile_last_message(spark: SparkSession, messages: list[dict]) -> list[dict]:
    """Messages whose last one, if it is a user's JSON array of objects, is compiled to compact text."""
    if not messages or messages[-1].get("role") != "user":
        return messages
    content = messages[-1].get("content")
    try:
        rows = json.loads(content) if isinstance(content, str) else content
    except ValueError:
        return messages
    if not (isinstance(rows, list) and rows and all(isinstance(r, dict) for r in rows)):
        return messages
    return [*messages[:-1], {**messages[-1], "content": compile_rows(spark, rows)}]


def quick(spark: SparkSession, rows: list[dict], model_name: str = "gpt-4o") -> dict:
    """Hash, tokens and savings against JSON in one call."""
    encoding = model(model_name)[1]
    text = compile_rows(spark, rows)
    own, plain = len(encode_text(text, encoding)), len(encode_text(json.dumps(rows, ensure_ascii=False, separators=(",", ":")), encoding))
    return {"hash": canonical.content_hash(rows), "text": text, "tokens": own, "json_tokens": plain, "saved_pct": round(100 * (1 - own / plain), 1) if plain else 0.0, "cost": own / 1e6 * model(model_name)[3]}


def analyze_savings(spark: SparkSession, rows: list[dict], names: list[str]) -> list[dict]:
    """quick() for several models; unknown ones are passed over."""
    return [{"model": n, **quick(spark, rows, n)} for n in names if n in MODELS]


def compose_from_hashes(store: ContentStore, hashes: list[str], system: str, model_name: str, reserve: int = B.RESERVE) -> DataFrame:
    """A system text and required stored blocks, in order, within a model's window."""
    spark, encoding = store.spark, model(model_name)[1]
    want = spark.createDataFrame([(k + 1, h) for k, h in enumerate(hashes)], "ord int, hash string")
    blocks = want.join(store.blobs(), "hash").select("ord", F.col("hash").alias("name"), token_count(F.col("body"), encoding).alias("tokens"))
    head = spark.createDataFrame([(0, "system", len(encode_text(system, encoding)))], "ord int, name string, tokens long")
    every = head.unionByName(blocks).select(F.lit(0).alias("prompt"), "ord", "name", F.lit(True).alias("required"), "tokens", F.lit(0).alias("max_tokens"))
    return B.compose(every, model_name, ["prompt"], reserve)


def token_lines(df: DataFrame, order: list[str], encoding: str = "o200k_base") -> DataFrame:
    """Rows as token arrays: cells between separators after the row mark; nulls leave gaps in a presence mask."""
    cells = D.melt(df, order).withColumn("ids", tokens(F.col("value"), encoding))
    g = cells.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("field_idx", "value", "ids"))).alias("cells"))
    width = len(D.leaves(df.drop(*order).schema))
    bit = lambda c: F.aggregate(F.filter("cells", lambda x: x["value"].isNotNull() & (F.floor(x["field_idx"] / 16) == c)), F.lit(0).cast("long"), lambda a, x: a + F.pow(F.lit(2), x["field_idx"] % 16).cast("long"))
    mask = F.array(F.lit(token_stream.MASKED), *[(bit(c) + token_stream.MASK_BASE).cast("int") for c in range((width + 15) // 16)])
    holes = F.exists("cells", lambda x: x["value"].isNull())
    body = F.flatten(F.transform(F.filter("cells", lambda x: x["value"].isNotNull()), lambda x: F.concat(x["ids"], F.array(F.lit(token_stream.SEPARATOR)))))
    return g.select(*order, F.concat(F.array(F.lit(token_stream.ROW)), F.when(holes, mask).otherwise(F.array().cast("array<int>")), body).alias("tokens"))


def encoding_stats(df: DataFrame, order: list[str], encoding: str = "o200k_base") -> DataFrame:
    """rows, unique_tokens, total_tokens, json_tokens, reduction_pct: the token stream of a dataset beside its JSON."""
    stream = token_lines(df, order, encoding)
    total = stream.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total_tokens"))
    unique = stream.select(F.explode("tokens").alias("token")).distinct().agg(F.count(F.lit(1)).alias("unique_tokens"))
    plain = df.select(token_count(render.json_row(df, order), encoding).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("json_tokens"))
    g = total.crossJoin(unique).crossJoin(plain)
    return g.select("rows", "unique_tokens", "total_tokens", "json_tokens", F.round(100 * (1 - F.coalesce(F.try_divide("total_tokens", "json_tokens"), F.lit(1.0))), 1).alias("reduction_pct"))


def prefix_reuse(df: DataFrame, order: list[str], text: str, by: list[str] | None = None, encoding: str = "o200k_base") -> DataFrame:
    """Tokens that each text shares with the one before it, and the totals per group."""
    by = by or []
    t = df.select(*by, *order, tokens(F.col(text), encoding).alias("ids"))
    t = t.withColumn("prev", F.lag("ids").over(Window.partitionBy(*by).orderBy(*order)))
    t = t.withColumn("shared", S.prefix_length(F.col("ids"), F.col("prev")))
    g = t.groupBy(*by).agg(F.sum(F.size("ids")).alias("tokens"), F.sum("shared").alias("shared"))
    return g.withColumn("reuse_pct", F.round(100 * F.coalesce(F.try_divide("shared", "tokens"), F.lit(0.0)), 1))


def prefix_simulation(df: DataFrame, order: str, n: int, change: dict, sort_by: str) -> DataFrame:
    """How many leading characters two renderings share after each kind of change, as stored and sorted by a key."""
    out = None
    for how in ("append", "prepend", "insert", "update", "delete", "shuffle", "single_field"):
        after = D.mutated(df, order, how, n, change)
        for name, key in (("stored", [order]), ("sorted", [sort_by, order])):
            texts = [x.select(*key, render.tsv_row(x, [order]).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, "line"))), lambda r: r["line"]), "\n").alias(c)) for x, c in ((df, "a"), (after, "b"))]
            one = texts[0].crossJoin(texts[1]).select(F.lit(how).alias("change"), F.lit(name).alias("rendering"), F.length(S.common_prefix(F.col("a"), F.col("b"))).alias("shared"), F.length("a").alias("chars"))
            out = one if out is None else out.unionByName(one)
    return out


def cache_warm(store: ContentStore, names: list[str]) -> dict[str, int]:
    """Tokens made for every stored blob and model; rows per model."""
    return {n: store.materialize(n, model(n)[1]).count() for n in names}


def cache_diagnose(store: ContentStore) -> DataFrame:
    """hash, model, ready: which blobs have tokens for which model."""
    pairs = store.blobs().select("hash").crossJoin(models_table(store.spark).select("model"))
    have = store.listing().select("hash", F.explode_outer("models").alias("model"), F.lit(True).alias("there")).filter("model is not null")
    return pairs.join(have, ["hash", "model"], "left").select("hash", "model", F.coalesce("there", F.lit(False)).alias("ready"))


def injects_tokens(model_flag: bool, environment: dict[str, str] | None = None) -> bool:
    """Whether token arrays rather than text go into a prompt."""
    return model_flag or (environment or {}).get("GRANARY_TOKEN_INJECTION", "") in ("1", "true")


def validate(spark: SparkSession, rows: list[dict]) -> dict[str, bool]:
    """Round trips of the formats that promise one, and whether the cells of the others can be read back."""
    canonical.validate(rows)
    blob = canonical.encode(rows)
    found = {
        "canonical": canonical.encode(canonical.decode(blob)) == blob,
        "record_text": record_text.decode(record_text.encode(rows)) is not None,
        "tokens": decode_tokens(encode_text(json.dumps(rows, ensure_ascii=False))) == json.dumps(rows, ensure_ascii=False),
    }
    if rows:
        df = frame_of(spark, rows)
        flat = D.flatten(df.drop("_ord")).columns
        cells = {(r["_ord"], flat.index(r["field"])): r["value"] or "" for r in D.melt(df, ["_ord"]).collect()}
        want = [[cells[o, k] for k in range(len(flat))] for o in sorted({o for o, _ in cells})]
        text = lambda fmt: render.document(render.lines(D.flatten(df), fmt, ["_ord"]), ["_ord"]).first()["document"]
        found["csv"] = list(csv.reader(io.StringIO(text("csv"), newline="")))[1:] == want
        plain = lambda c: c.replace("\t", " ").replace("\n", " ").replace("\r", "")
        found["tsv"] = [len(x.split("\t")) for x in text("tsv").split("\n")[1:]] == [len(flat)] * len(want) or any("\t" in c or "\n" in c for r in want for c in r)
        found["markdown"] = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", x)[1:-1]] for x in text("markdown").split("\n")[2:]] == [[plain(c).strip() for c in r] for r in want]
        found["compact"] = bool(text("compact"))
    return found


@dataclass
class Profile:
    """Wall and CPU seconds of named stages."""

    stages: dict[str, tuple[float, float]] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str):
        wall, cpu = time.perf_counter(), time.process_time()
        try:
            yield
        finally:
            self.stages[name] = (time.perf_counter() - wall, time.process_time() - cpu)
            log.debug("%s took %.3f s", name, self.stages[name][0])

    def total(self) -> float:
        return sum(w for w, _ in self.stages.values())
