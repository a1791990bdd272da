"""Queries: stores, facade, token datasets, row filters, prefix reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary import api
from granary.engine import Engine
from granary.functions import canonical
from granary.operators import dataset as D
from granary.operators import render, session, stats
from granary.plans.miniquery import parse
from granary.plans.models import models_sql, models_table
from granary.queries_plans import stored
from granary.registry import query
from granary.sources import files


@query("f01_parse", "SELECT * FROM (VALUES ('GET a WHERE b = c LIMIT 5 FORMAT csv', 'a', 'b = c', 5, 'csv'), ('get a limit 0', 'a', NULL, 0, NULL), ('GET a WHERE b =', 'a', NULL, NULL, NULL), ('GET a x LIMIT 1 LIMIT 2', 'a', NULL, 2, NULL)) AS v(text, dataset, cond, lim, format)")
def _(t):
    texts = ["GET a WHERE b = c LIMIT 5 FORMAT csv", "get a limit 0", "GET a WHERE b =", "GET a x LIMIT 1 LIMIT 2"]
    rows = [(x, q.dataset, " ".join(q.where) if q.where else None, q.limit, q.format) for x, q in ((x, parse(x)) for x in texts)]
    return t("region").sparkSession.createDataFrame(rows, "text string, dataset string, cond string, lim int, format string")


@query("r13_query_result", "SELECT c_custkey, c_name || ',' || c_nationkey::VARCHAR AS line FROM customer WHERE c_nationkey > 20 ORDER BY c_custkey LIMIT 50")
def _(t):
    e = Engine(t("region").sparkSession)
    e.register("customer", t("customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])
    return e.query("GET customer WHERE c_nationkey > 20 LIMIT 50 FORMAT csv").lines().filter("part = 1").select("c_custkey", "line")


@query("r14_context_window", "SELECT c_custkey, c_name || chr(9) || c_nationkey::VARCHAR AS line FROM customer WHERE c_nationkey < 3 ORDER BY c_custkey LIMIT 20")
def _(t):
    e = Engine(t("region").sparkSession)
    e.register("customer", t("customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])
    return e.context("customer", "c_nationkey < 3", 20).lines().filter("part = 1").select("c_custkey", "line")


@query("s10_store_get", "SELECT sha256(text) AS hash, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE doc_id = 3 LIMIT 1")
def _(t):
    d = t("documents")
    want = d.filter("doc_id = 3").select(F.sha2("text", 256).alias("hash")).first()["hash"]
    return stored(t, d).get(want).select("hash", "bytes")


@query("s11_store_listing", "WITH b AS (SELECT DISTINCT sha256(text) AS hash FROM documents), c AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id % 3 = 0) SELECT hash, c.hash IS NOT NULL AS cached FROM b LEFT JOIN c USING (hash)")
def _(t):
    d = t("documents")
    kept = stored(t, d.filter("doc_id % 3 = 0"))
    kept.materialize("gpt-4o")
    kept.put(d.select(F.col("text").alias("body"), F.lit(1).cast("long").alias("rows")))
    return kept.listing().select("hash", F.col("models").isNotNull().alias("cached"))


@query("t04_model_encoding", f"SELECT model, encoding FROM {models_sql()}")
def _(t):
    return models_table(t("region").sparkSession).select("model", "encoding")


@query("t09_prefix_reuse", None)
def _(t):
    return api.prefix_reuse(t("conversations"), ["turn"], "text", ["conv_id"])


@query("t10_prefix_simulation", None)
def _(t):
    s = D.ordered(t("supplier").select("s_suppkey", "s_name"), "s_suppkey").select(F.col("_ord").alias("o"), "s_suppkey", "s_name")
    return api.prefix_simulation(s, "o", s.count(), {"s_name": F.lit("changed")}, "s_suppkey")


@query("r10_token_lines", None)
def _(t):
    return api.token_lines(t("nation"), ["n_nationkey"])


@query("r16_compiled", None)
def _(t):
    n = t("nation")
    return render.document(render.lines(n, "compact", ["n_nationkey"]), ["n_nationkey"])


@query("o15_quick", None)
def _(t):
    n = t("region")
    q = api.quick(n.sparkSession, [r.asDict() for r in n.orderBy("r_regionkey").collect()])
    return n.sparkSession.createDataFrame([(q["hash"], q["tokens"], q["json_tokens"])], "hash string, tokens long, json_tokens long")


@query("p16_object_rows", "SELECT count(*) AS n FROM events WHERE event_id % 4 <> 0")
def _(t):
    mixed = t("events").select(F.when(F.col("event_id") % 4 == 0, F.lit("[1]")).otherwise(F.col("props")).alias("doc"))
    return mixed.filter(F.expr("schema_of_variant(parse_json(doc)) LIKE 'OBJECT%'")).agg(F.count(F.lit(1)).alias("n"))


@query("p19_depths", "SELECT 4 AS depth, 3 AS paths, count(*) AS rows FROM nation")
def _(t):
    n = t("nation").select(F.struct("n_name", F.struct("n_nationkey", F.array("n_regionkey").alias("arr")).alias("in")).alias("doc"))
    return n.agg(F.lit(stats.nesting(n.schema)).alias("depth"), F.lit(len(D.leaves(n.schema))).alias("paths"), F.count(F.lit(1)).alias("rows"))


@query("p15_validation", "SELECT n_nationkey, n_nationkey % 3 <> 0 AND n_nationkey <> 1 AS valid FROM nation")
def _(t):
    n = t("nation")
    # Every third row has a key that is not allowed, one more is nested too deeply.
    key, deep = F.col("n_nationkey"), "[" * 60 + "]" * 60
    doc = F.when(key % 3 == 0, F.lit('{"a":{"__proto__":1}}')).when(key == 1, F.lit(deep)).otherwise(render.json_row(n, []))
    return n.select("n_nationkey", canonical.valid(doc).alias("valid"))


@query("a22_session_stats", """
WITH v AS (SELECT DISTINCT conv_id AS b, text AS v FROM conversations WHERE text <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY b) > 1 AS known FROM v)
SELECT count(DISTINCT b) AS batches, count(DISTINCT v) AS dictionary, count(*) FILTER (known) AS hits FROM k""")
def _(t):
    c = t("conversations").select(F.col("conv_id").alias("batch"), F.col("text").alias("value"))
    s = session.session_savings(c, c.select("batch").distinct().withColumn("signature", F.lit("text")), "batch")
    return s.agg(F.count(F.lit(1)).alias("batches"), F.sum("new_entries").alias("dictionary"), F.sum("dict_hits").alias("hits"))


@query("z03_session_state", "SELECT text AS value, count(DISTINCT conv_id) AS occurrences FROM conversations WHERE text <> '' GROUP BY 1")
def _(t):
    c = t("conversations")
    values = c.select(F.col("conv_id").alias("batch"), F.col("text").alias("value"))
    schemas = c.select(F.col("conv_id").alias("batch"), F.lit("conv_id,role,text,turn").alias("signature"))
    return session.SessionState(c.sparkSession).observe_batches(values, schemas, "batch").texts


@query("s26_diagnostics", "SELECT count(*) AS records, count(DISTINCT event_type) AS operations FROM events")
def _(t):
    e = t("events").select("event_id", "event_type")
    path = files.scratch(e.sparkSession, "diagnostics")
    files.save_diagnostics(e, path)
    back = files.load_diagnostics(e.sparkSession, path, "event_id bigint, event_type string")
    return back.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("event_type").alias("operations"))


@query("s20_export_lines", "SELECT 'csv' AS format, count(*) + 1 AS lines FROM region UNION ALL SELECT 'markdown', count(*) + 2 FROM region UNION ALL SELECT 'tsv', count(*) + 1 FROM region UNION ALL SELECT 'json_min', count(*) FROM region")
def _(t):
    out = None
    for fmt in ("csv", "markdown", "tsv", "json_min"):
        one = render.lines(t("region"), fmt, ["r_regionkey"]).agg(F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("lines"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s21_transcoded_xml", None)
def _(t):
    return files.transcoded(t("region"), "xml", ["r_regionkey"])


@query("o02_row_fit", """
WITH u AS (SELECT n_nationkey, sum(ceil(length(n_name || ',' || n_regionkey::VARCHAR) / 4.0)::BIGINT + 1) OVER (ORDER BY n_nationkey) - 1 AS used FROM nation)
SELECT count(*) AS rows, max(used)::BIGINT AS tokens FROM u WHERE used <= 40""")
def _(t):
    from granary.functions.scalar import token_estimate
    from granary.operators.budget import rows_within

    lines = render.lines(t("nation"), "csv", ["n_nationkey"]).filter("part = 1")
    return rows_within(lines, ["n_nationkey"], token_estimate(F.col("line")), 40)
