"""python -m granary VERB FILE [...]: verbs over a JSON array file."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary import api
from granary.engine import Engine
from granary.operators import guard, render, stats
from granary.operators.store import ContentStore
from granary.sources import files


#: Verbs over a file, and verbs over what is stored.
FILE_VERBS = ("analyze", "stats", "formats", "convert", "query", "savings", "encode", "decode", "validate", "budget", "guard", "scorecard", "ir-encode", "inject", "bench")
STORE_VERBS = ("status", "cache-stats", "cache-warm", "cache-diagnose", "ir-inspect", "ir-materialize", "compose")
VERBS = [*FILE_VERBS, *STORE_VERBS]


def stored_verb(spark: SparkSession, a: argparse.Namespace) -> int:
    """A verb over the datasets in a store."""
    store = ContentStore(spark, a.store)
    if a.verb in ("status", "cache-stats"):
        for r in store.listing().orderBy("hash").collect():
            print(r.hash, r.rows, r.bytes, ",".join(r.models or []))
    elif a.verb == "cache-warm":
        print(json.dumps(api.cache_warm(store, a.model.split(","))))
    elif a.verb == "cache-diagnose":
        for r in api.cache_diagnose(store).filter(F.col("model").isin(a.model.split(","))).orderBy("hash").collect():
            print(r.hash, r.model, "ready" if r.ready else "cold")
    elif a.verb == "compose":
        for r in api.compose_from_hashes(store, a.file.split(","), a.system, a.model).orderBy("ord").collect():
            print(r.ord, r["name"], r.tokens, r.included)
    else:
        found = api.StoredDataset.load(spark, store, a.file)
        print(json.dumps({"hash": found.hash, "rows": len(found.rows), "bytes": len(found.blob)} | ({"tokens": found.token_count(a.model)} if a.verb == "ir-materialize" else {})))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="granary")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("file", help="a JSON array; for the verbs of stored datasets (see below) their hashes, separated by commas")
    p.add_argument("--store", default="granary-store", help="folder of stored datasets")
    p.add_argument("--system", default="", help="system text of compose")
    p.add_argument("--format", default="compact")
    p.add_argument("--model", default="gpt-4o")
    p.add_argument("--query", default="GET data")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("granary").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.verb in STORE_VERBS:
        return stored_verb(spark, a)
    if a.verb == "decode":
        with open(a.file, encoding="utf-8") as f:
            print(json.dumps(api.record_text.decode(f.read()), ensure_ascii=False))
        return 0
    df = files.read_json_array(spark, a.file)
    with open(a.file, encoding="utf-8") as f:
        rows = json.load(f)
    if not isinstance(rows, list):
        print("the file must hold a JSON array", file=sys.stderr)
        return 1
    engine = Engine(spark)
    engine.register("data", df, ["_ord"])
    if a.verb in ("analyze", "stats"):
        print(json.dumps(stats.complexity(df, ["_ord"]).first().asDict()))
    elif a.verb == "formats":
        for r in render.sizes(df, ["_ord"]).collect():
            print(r.format, r.bytes, r.tokens)
    elif a.verb == "convert":
        print(engine.query("GET data").output(a.format))
    elif a.verb == "query":
        print(engine.query(a.query).output())
    elif a.verb == "savings":
        for r in engine.savings("data").collect():
            print(r.format, r.model, r.tokens, r.cost_per_1k)
    elif a.verb == "encode":
        print(json.dumps({k: v for k, v in api.quick(spark, rows, a.model).items() if k != "text"}))
    elif a.verb == "budget":
        for r in engine.budget("data", a.model).collect():
            print(r.format, r.rows, r.tokens, r.tokens_per_row, r.cost_per_1m)
    elif a.verb == "guard":
        body = df.drop("_ord")
        g = guard.semantic_guard(body, spark.read.schema(body.schema).json(body.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).rdd.map(lambda r: r.line)))
        r = g.first()
        print(json.dumps(r.asDict()))
        return int(not r.passed)
    elif a.verb == "scorecard":
        q = api.quick(spark, rows, a.model)
        print(json.dumps({"reduction": q["saved_pct"], "passed": q["saved_pct"] >= 35}))
    elif a.verb == "ir-encode":
        made = api.StoredDataset.encode(spark, ContentStore(spark, a.store), rows)
        print(hashlib.sha256(made.to_json().encode()).hexdigest())
    elif a.verb == "inject":
        found = spark.createDataFrame([(a.system or "{{DATA:data}}",)], "prompt string")
        known = spark.createDataFrame([("data", api.compile_rows(spark, rows, a.format))], "name string, document string")
        print(files.injected(found, "prompt", known).first().prompt)
    elif a.verb == "bench":
        profile = api.Profile()
        for fmt in ("json_min", "csv", "markdown", "tsv", "compact", "record_text"):
            with profile.stage(fmt):
                engine.query("GET data").output(fmt)
        print(json.dumps({k: round(w, 4) for k, (w, _) in profile.stages.items()}))
    else:
        found = api.validate(spark, rows)
        print(json.dumps(found))
        return int(not all(found.values()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
