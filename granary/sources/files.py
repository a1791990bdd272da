"""Reading and writing datasets: JSON arrays, tables, text formats, logs."""

from __future__ import annotations

import json
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from granary.errors import UnknownFormatError
from granary.operators import render
from granary.operators.dataset import ORDER, ordered, sort_keys


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file with a JSON array of objects, in order. Such a file is one task's work; tables and JSON lines are not."""
    df = spark.read.option("multiLine", True).json(path)
    return df.withColumn(ORDER, F.monotonically_increasing_id())


def append(df: DataFrame, path: str, order: str = ORDER) -> None:
    """Append rows (with own order from 0) behind those that are stored."""
    spark = df.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max(order)).first()[0]
    except AnalysisException:
        last = None
    start = 0 if last is None else last + 1
    df.withColumn(order, (F.col(order) + start).cast("long")).write.mode("append").parquet(path)


def read_dataset(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stored dataset; a missing one is empty."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema or f"{ORDER} long")


def list_datasets(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def drop_dataset(spark: SparkSession, name: str) -> bool:
    there = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return there


@F.pandas_udf(T.StringType())
def _yaml(s: pd.Series) -> pd.Series:
    def put(v, indent: int) -> str:
        pad = "  " * indent
        if isinstance(v, dict) and v:
            return "\n".join(f"{pad}{k}:" + ("\n" + put(x, indent + 1) if isinstance(x, (dict, list)) and x else " " + put(x, 0)) for k, x in v.items())
        if isinstance(v, list) and v:
            return "\n".join(f"{pad}-" + ("\n" + put(x, indent + 1) if isinstance(x, (dict, list)) and x else " " + put(x, 0)) for x in v)
        return json.dumps(v, ensure_ascii=False)

    return s.map(lambda t: put([json.loads(t)], 0))


def transcoded(df: DataFrame, fmt: str, order: list[str]) -> DataFrame:
    """Order columns and a text per row, keys sorted: json, ndjson, yaml, xml; or lines of csv, markdown, tsv, record_text, compact."""
    body = sort_keys(df.drop(*order))
    whole = df.select(*order, *[F.col(f"`{c}`") for c in body.columns])
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in body.columns]), {"ignoreNullFields": "false"})
    if fmt in ("json", "json_min", "ndjson"):
        return whole.select(*order, row.alias("line"))
    if fmt == "yaml":
        return whole.select(*order, _yaml(row).alias("line"))
    if fmt == "xml":
        return whole.select(*order, F.to_xml(F.struct(*[F.col(f"`{c}`") for c in body.columns]), {"rowTag": "row"}).alias("line"))
    if fmt in ("csv", "markdown", "tsv", "record_text", "compact"):
        return render.lines(whole, fmt, order)
    raise UnknownFormatError(fmt)


def export(df: DataFrame, order: list[str], path: str, formats: tuple[str, ...] = ("json_min", "csv", "markdown", "tsv", "record_text", "compact")) -> None:
    """One folder of text files per format beside each other."""
    for fmt in formats:
        render.write_lines(render.lines(df, fmt, order), order, f"{path}/{fmt}")


def snapshot(runs: DataFrame, path: str) -> None:
    """Append runs (ts, command, input, model, metrics) to the log."""
    runs.write.mode("append").parquet(path)


def previous_run(spark: SparkSession, path: str, command: str, source: str, model: str):
    """The latest run with the same key, or None."""
    try:
        log = spark.read.parquet(path)
    except AnalysisException:
        return None
    return log.filter((F.col("command") == command) & (F.col("input") == source) & (F.col("model") == model)).orderBy(F.col("ts").desc()).first()


def load_documents(docs: DataFrame, id_col: str, text_col: str, most: int | None = None) -> DataFrame:
    """Documents as a dataset: _index (by id), _id, _content, _metadata (the other columns as JSON)."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = ordered(docs, id_col)
    meta = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    out = rows.select(F.col(ORDER).alias("_index"), F.col(id_col).alias("_id"), F.col(text_col).alias("_content"), meta.alias("_metadata"))
    return out.filter(F.col("_index") < most) if most else out


def save_diagnostics(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def load_diagnostics(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def generated(spark: SparkSession, family: str, n: int, seed: int = 42) -> DataFrame:
    """Synthetic datasets by expressions of the row number; equal for equal seeds."""
    i = F.col("id")
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    number = lambda k, m: F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(m))
    day = F.date_format(F.timestamp_seconds(F.lit(1704067200) + i * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = spark.range(n)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta", "omega"))), (F.pmod(F.xxhash64(i, k), F.lit(5)) + 1).cast("int"))), " ")
    families = {
        "flat": [i, F.concat(F.lit("User "), i).alias("name"), F.concat(F.lit("user"), i, F.lit("@example.com")).alias("email"), (number(1, 2) == 0).alias("active"), pick(2, "admin", "user", "guest").alias("role"), day.alias("createdAt")],
        "nested": [i, F.struct(F.concat(F.lit("u"), i).alias("name"), F.struct(text.alias("bio"), (number(1, 60) + 18).alias("age")).alias("profile")).alias("user"), F.struct(pick(3, "dark", "light").alias("theme")).alias("settings")],
        "sparse": [i, F.when(number(1, 5) == 0, text).alias("description"), F.when(number(2, 5) == 0, pick(3, "eu", "us")).alias("region"), F.when(number(4, 5) == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags")],
        "repetitive": [pick(1, "active", "closed", "open").alias("status"), pick(1, "A", "B", "C").alias("type"), F.lit("eu-west-1").alias("region"), F.lit("1.0.0").alias("version")],
        "long_text": [i, F.concat(F.lit("Title "), i).alias("title"), F.repeat(F.concat(text, F.lit(". ")), 6).alias("content")],
        "tickets": [i, F.concat(F.lit("Customer "), number(1, 200)).alias("customer"), pick(2, "login fails", "slow page", "billing").alias("subject"), pick(3, "open", "closed", "pending").alias("status"), pick(4, "low", "medium", "high").alias("priority"), day.alias("created"), F.when(number(5, 3) > 0, F.concat(F.lit("agent"), number(6, 9))).alias("agent"), text.alias("notes")],
        "wide": [i, *[((number(k, 1000)) if k % 3 == 0 else (number(k, 2) == 0) if k % 3 == 1 else F.concat(F.lit("v"), number(k, 50))).alias(f"col_{k:03d}") for k in range(1, 40)]],
        "deep": [i, F.struct(F.struct(F.struct(F.struct(F.struct(pick(1, "x", "y").alias("leaf_value"), number(2, 100).alias("leaf_num")).alias("e")).alias("d")).alias("c")).alias("b")).alias("root")],
        "extremely_sparse": [i, *[F.when(number(k, 9) == 0, F.concat(F.lit("f"), number(k + 100, 30))).alias(f"field_{k:02d}") for k in range(20)]],
        "short_strings": [i, *[pick(k, "a", "bb", "ccc", "dddd", "eeeee").alias("abcde"[k]) for k in range(5)]],
        "numeric": [i, number(1, 10**6).alias("int_val"), (number(2, 10**6) / 1000).alias("float_val"), (-number(3, 1000)).alias("neg_int"), (number(4, 1000) / 10**6).alias("small_float"), (number(5, 10**9) * 1000).alias("big_int"), F.lit(0).alias("zero")],
        "orders": [F.concat(F.lit("SKU-"), F.lpad(i.cast("string"), 6, "0")).alias("sku"), text.alias("description"), pick(1, "books", "toys", "tools").alias("category"), (number(2, 50000) / 100).alias("price"), F.lit("EUR").alias("currency"), (number(3, 4) > 0).alias("inStock"), F.transform(F.sequence(F.lit(1), (number(4, 3) + 1).cast("int")), lambda k: F.struct(k.alias("size"), (k * 2).alias("extra"))).alias("variants")],
        "patients": [F.concat(F.lit("P"), F.lpad(i.cast("string"), 8, "0")).alias("patientId"), F.struct((number(1, 90)).alias("age"), pick(2, "f", "m", "x").alias("sex")).alias("demographics"), F.struct((number(3, 60) + 90).alias("systolic"), (number(4, 40) + 60).alias("pulse")).alias("vitals"), F.when(number(5, 4) == 0, pick(6, "nuts", "pollen")).alias("allergies"), pick(7, "admitted", "discharged").alias("status")],
        "iot": [F.concat(F.lit("dev-"), number(1, 50)).alias("deviceId"), pick(2, "temp", "hum").alias("sensorType"), day.alias("timestamp"), F.struct((number(3, 1000) / 10).alias("value"), (number(4, 10) / 10).alias("stdDev")).alias("readings"), number(5, 100).alias("batteryPct"), pick(6, "ok", "warn").alias("status")],
        "payments": [F.concat(F.lit("tx"), i).alias("txId"), pick(1, "debit", "credit").alias("type"), (number(2, 10**7) / 100).alias("amount"), F.lit("USD").alias("currency"), number(3, 500).alias("fromAccount"), number(4, 500).alias("toAccount"), pick(5, "settled", "pending").alias("status"), day.alias("timestamp"), F.when(number(6, 3) == 0, number(7, 100) / 100).alias("taxAmount")],
        "logs": [i, day.alias("timestamp"), pick(1, "INFO", "WARN", "ERROR").alias("level"), pick(2, "api", "db", "web").alias("service"), text.alias("message"), F.struct(F.sha2(i.cast("string"), 256).alias("traceId")).alias("context"), pick(3, 200, 404, 500).alias("httpStatus"), number(4, 2000).alias("duration_ms")],
        "activity": [i.alias("eventId"), F.concat(F.lit("s"), number(1, 500)).alias("sessionId"), number(2, 300).alias("userId"), pick(3, "view", "click", "buy").alias("action"), pick(4, "/", "/cart", "/help").alias("page"), day.alias("timestamp"), F.struct(pick(5, "ios", "android", "web").alias("os")).alias("device")],
        "chat": [i, F.concat(F.lit("c"), F.floor(i / 6)).alias("conversationId"), F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), text.alias("content"), F.struct(number(1, 500).alias("prompt"), number(2, 500).alias("completion")).alias("tokens"), day.alias("timestamp")],
        "api": [F.concat(F.lit("r"), i).alias("requestId"), pick(1, "/users", "/orders").alias("endpoint"), pick(2, 200, 201, 400).alias("status"), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(k.alias("id"), F.concat(F.lit("n"), k).alias("name"))).alias("data"), number(3, 900).alias("responseTime_ms")],
        "places": [F.concat(F.lit("pl"), i).alias("placeId"), pick(1, "cafe", "park", "museum").alias("type"), F.struct((number(2, 18000) / 100 - 90).alias("lat"), (number(3, 36000) / 100 - 180).alias("lng")).alias("coordinates"), (number(4, 50) / 10).alias("rating"), F.array(pick(5, "wifi", "garden"), pick(6, "quiet", "busy")).alias("tags")],
        "inventory": [F.concat(F.lit("INV-"), i).alias("sku"), pick(1, "bolts", "nuts", "gears").alias("category"), pick(2, "north", "south").alias("warehouse"), number(3, 1000).alias("quantity"), (number(4, 10000) / 100).alias("unitCost"), pick(5, "ok", "low").alias("status"), F.when(number(6, 4) == 0, day).alias("expiryDate")],
        "articles": [i.alias("articleId"), F.concat(F.lit("slug-"), i).alias("slug"), F.concat(F.lit("Title "), i).alias("title"), F.repeat(text, 3).alias("body"), pick(1, "news", "guide").alias("category"), pick(2, "draft", "published").alias("status"), number(3, 10**5).alias("views")],
        "languages": [i, pick(1, "Guten Tag", "Bonjour", "こんにちは", "Привет", "مرحبا", "नमस्ते").alias("greeting"), pick(2, "de", "fr", "ja", "ru", "ar", "hi").alias("locale"), text.alias("body")],
        "mixed": [F.when(i % 2 == 0, F.to_json(F.struct(i, F.concat(F.lit("n"), i).alias("name")))).otherwise(F.to_json(F.struct(i, F.struct(pick(1, "a", "b").alias("tag")).alias("meta")))).alias("doc")],
    }
    if family not in families:
        raise ValueError(f"unknown family: {family}")
    return base.select(*families[family])


FAMILIES = ("flat", "nested", "sparse", "repetitive", "long_text", "tickets", "wide", "deep", "mixed", "extremely_sparse", "short_strings", "numeric", "orders", "patients", "iot", "payments", "logs", "activity", "chat", "api", "places", "inventory", "articles", "languages")


def last_row_text(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The last user turn of each conversation."""
    users = conversations.filter(F.col(role) == "user")
    return users.groupBy(conv).agg(F.max(turn).alias(turn), F.max_by(text, turn).alias(text))


def has_placeholder(text: Column, prefix: str = "DATA") -> Column:
    return text.rlike(r"\{\{" + prefix + r":[A-Za-z0-9_-]+\}\}")


def injected(prompts: DataFrame, text: str, renderings: DataFrame, prefix: str = "DATA") -> DataFrame:
    """Prompts with {{DATA:name}} replaced by renderings (name, document); unknown names stay as they are.

    The registry becomes one map, a single row that is broadcast; a prompt is cut at its placeholders
    once, so that documents which hold placeholders themselves are put in as they are.
    """
    mark = r"\{\{" + prefix + r":([A-Za-z0-9_-]+)\}\}"
    known = renderings.dropDuplicates(["name"]).agg(F.map_from_entries(F.collect_list(F.struct("name", "document"))).alias("__known"))
    rows = prompts.crossJoin(F.broadcast(known))
    parts, names = F.split(F.col(text), mark, -1), F.regexp_extract_all(F.col(text), F.lit(mark), F.lit(1))
    shown = F.transform(names, lambda n: F.coalesce(F.try_element_at(F.col("__known"), n), F.concat(F.lit("{{" + prefix + ":"), n, F.lit("}}"))))
    whole = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(shown, i), F.lit("")))), "")
    return rows.withColumn(text, whole).select(*prompts.columns)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir); local sessions without it get one of their own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def latest_runs(log: DataFrame, keys: list[str], order: list[str], run: str) -> DataFrame:
    """For each key the last run and the number of runs in the log."""
    return log.groupBy(*keys).agg(F.max_by(run, F.struct(*order)).alias("last_run"), F.count(F.lit(1)).alias("runs"))
