"""Queries: budgets, packing, composition, format and strategy choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.engine import Engine, optimized
from granary.functions import scalar as S
from granary.functions.tokens import token_count
from granary.operators import budget as B
from granary.operators import guard, render, telemetry
from granary.plans.models import models_sql, models_table
from granary.registry import query

EVENT = "event_id::VARCHAR || ',' || user_id::VARCHAR || ',' || event_type || ',' || CASE WHEN contains(props, ',') OR contains(props, '\"') THEN '\"' || replace(props, '\"', '\"\"') || '\"' ELSE props END"
ITEMS = """SELECT source AS grp, doc_id AS id, ceil(n_chars / 4.0)::BIGINT AS tokens,
 CASE WHEN doc_id % 11 = 0 THEN 0.0::DOUBLE ELSE (doc_id % 101)::DOUBLE / 100 * 0.5::DOUBLE + 0.5::DOUBLE * 0.2::DOUBLE + ((doc_id % 7)::DOUBLE / 7) * 0.3::DOUBLE END AS score FROM documents"""


def items(t):
    i = F.col("doc_id")
    priority = F.when(i % 11 == 0, 0).otherwise(i % 101)
    score = F.when(i % 11 == 0, 0.0).otherwise(B.item_score(F.when(i % 101 == 0, 1e-300).otherwise(priority.cast("double")), F.lit(None).cast("double"), (i % 7).cast("double") / 7))
    return t("documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), F.ceil(F.col("n_chars") / 4).cast("long").alias("tokens"), score.alias("score"))


def fold(rank, extra=""):
    """SQL of the greedy fold: items of a group in rank order, taken if they fit."""
    return f"""
WITH RECURSIVE i AS ({ITEMS}), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {rank}, id) AS n FROM i),
 r AS (SELECT grp, 0::BIGINT AS n, 20000::BIGINT AS remaining, -1::BIGINT AS id, false AS selected FROM (SELECT DISTINCT grp FROM k)
  UNION ALL
  SELECT k.grp, k.n, r.remaining - CASE WHEN {extra} k.score <> 0 AND k.tokens <= r.remaining THEN k.tokens ELSE 0 END, k.id, {extra} k.score <> 0 AND k.tokens <= r.remaining FROM r JOIN k ON k.grp = r.grp AND k.n = r.n + 1)
SELECT r.grp, r.id, k.tokens, round(k.score, 9) AS score, r.selected, CASE WHEN k.score = 0 THEN 'zero_priority' WHEN NOT r.selected THEN 'over_budget' END AS reason FROM r JOIN k ON k.grp = r.grp AND k.n = r.n"""


@query("o17_optimized_context", f"""
WITH l AS (SELECT event_id, user_id, {EVENT} AS line FROM (SELECT event_id, user_id, event_type, props FROM events) WHERE event_type = 'purchase'),
 u AS (SELECT *, sum(ceil(length(line) / 4.0)::BIGINT + 1) OVER (ORDER BY event_id) - 1 AS used FROM l)
SELECT event_id, (row_number() OVER (ORDER BY user_id, event_id) - 1)::INTEGER AS pos, line FROM u WHERE used <= 2000""")
def _(t):
    return optimized(t("events").select("event_id", "user_id", "event_type", "props"), ["event_id"], "event_type = purchase", 2000, "user_id", "csv")


@query("o01_budget_rows", """
WITH l AS (SELECT source, doc_id, ceil(length(text) / 4.0)::BIGINT AS tok FROM documents), u AS (SELECT *, sum(tok + 1) OVER (PARTITION BY source ORDER BY doc_id) - 1 AS used FROM l)
SELECT source, count(*) AS rows, max(used)::BIGINT AS tokens FROM u WHERE used <= 10000 GROUP BY 1""")
def _(t):
    return B.rows_within(t("documents"), ["doc_id"], S.token_estimate(F.col("text")), 10_000, ["source"])


@query("o01_budget_result", f"""
WITH m AS (SELECT floor((window_ - 4096) * 0.95::DOUBLE)::BIGINT AS room, input_price FROM {models_sql()} WHERE model = 'gpt-4o'),
 l AS (SELECT c_custkey, ceil(length(c_custkey::VARCHAR || ',' || c_name || ',' || c_nationkey::VARCHAR) / 4.0)::BIGINT AS tok FROM customer),
 u AS (SELECT *, sum(tok + 1) OVER (ORDER BY c_custkey) - 1 AS used FROM l), g AS (SELECT count(*) AS rows, max(used)::BIGINT AS tokens FROM u, m WHERE used <= room)
SELECT format, rows, tokens, ceil(tokens / rows)::BIGINT AS tokens_per_row, round(tokens * input_price, 2) AS cost_per_1m FROM g, m, (VALUES ('csv'), ('tsv')) AS f(format)""")
def _(t):
    e = Engine(t("region").sparkSession)
    c = t("customer")
    e.register("customer", c.select(F.col("c_custkey").alias("_o"), "c_custkey", "c_name", "c_nationkey"), ["_o"])
    return e.budget("customer", "gpt-4o", ("csv", "tsv"))


@query("l04_max_rows", """
WITH u AS (SELECT o_orderkey, sum(ceil(length(o_orderkey::VARCHAR || ',' || o_orderstatus) / 4.0)::BIGINT + 1) OVER (ORDER BY o_orderkey) - 1 AS used FROM orders)
SELECT count(*) AS rows, max(used)::BIGINT AS tokens FROM u WHERE used <= 12345""")
def _(t):
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus")
    return B.rows_within_large(t("orders"), "o_orderkey", S.token_estimate(line), 12_345)


@query("o01_budget_rows_bpe", None)
def _(t):
    return B.rows_within(t("documents"), ["doc_id"], token_count(F.col("text")), 10_000, ["source"])


@query("o01_available", "SELECT model, greatest(0, floor((window_ - 1000 - 4096) * 0.95::DOUBLE))::BIGINT AS available FROM " + models_sql())
def _(t):
    m = models_table(t("region").sparkSession)
    return m.select("model", B.available_column(F.col("window"), 1000).alias("available"))


@query("o03_scores", f"SELECT id, round(score, 9) AS score FROM ({ITEMS})")
def _(t):
    return items(t).select("id", F.round("score", 9).alias("score"))


@query("o04_greedy", fold("-score"))
def _(t):
    return B.packed(items(t), 20_000, ["grp"], "greedy").withColumn("score", F.round("score", 9))


@query("o05_density", fold("-(score / tokens)"))
def _(t):
    return B.packed(items(t), 20_000, ["grp"], "density").withColumn("score", F.round("score", 9))


@query("o06_knapsack", None)
def _(t):
    return B.packed(items(t), 5_000, ["grp"], "knapsack")


@query("o07_pack_result", f"SELECT grp, count(*) FILTER (selected) AS items, coalesce(sum(tokens) FILTER (selected), 0)::BIGINT AS tokens, floor(coalesce(sum(tokens) FILTER (selected), 0) * 1000 / 20000.0::DOUBLE + 0.5) / 10 AS utilization FROM ({fold('-score')}) GROUP BY grp")
def _(t):
    return B.pack_result(B.packed(items(t), 20_000, ["grp"], "greedy"), 20_000, ["grp"]).select("grp", "items", "tokens", "utilization")


@query("o13_compose", """
WITH RECURSIVE b AS (SELECT conv_id, turn AS ord, role AS name, turn = 0 AS required, least(ceil(length(text) / 4.0)::BIGINT, 400) AS tok FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS n FROM b),
 r AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS got FROM (SELECT DISTINCT conv_id FROM k)
  UNION ALL
  SELECT k.conv_id, k.n, r.used + greatest(CASE WHEN k.tok <= 600 - r.used THEN k.tok WHEN k.required THEN -1 ELSE 600 - r.used END, 0), CASE WHEN k.tok <= 600 - r.used THEN k.tok WHEN k.required THEN -1 ELSE 600 - r.used END FROM r JOIN k ON k.conv_id = r.conv_id AND k.n = r.n + 1)
SELECT r.conv_id, k.ord, k.name, r.got > 0 OR r.got = k.tok AS included, greatest(r.got, 0) AS tokens, CASE WHEN r.got < 0 THEN 'overflow' WHEN r.got = k.tok THEN NULL WHEN r.got > 0 THEN 'truncated' ELSE 'budget full' END AS reason
FROM r JOIN k ON k.conv_id = r.conv_id AND k.n = r.n""")
def _(t):
    c = t("conversations")
    blocks = c.select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("name"), (F.col("turn") == 0).alias("required"), S.token_estimate(F.col("text")).alias("tokens"), F.lit(400).alias("max_tokens"))
    return B.composed(blocks, 600, ["conv_id"])


@query("o08_select_format", """
WITH s AS (SELECT source, count(*) AS rows, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END)::DOUBLE AS sparsity, sum(n_chars) / 4.0 / 128000 AS pressure FROM documents GROUP BY 1)
SELECT source, CASE WHEN rows < 5 THEN 'json' WHEN sparsity > 0.8 THEN 'json' ELSE 'compact' END AS format, least(0.95::DOUBLE, 0.35::DOUBLE + CASE WHEN rows > 20 THEN 0.05::DOUBLE ELSE 0 END + 0.05::DOUBLE) AS expected FROM s""")
def _(t):
    s = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)).alias("sparsity"), (F.sum("n_chars") / 4 / 128000).alias("pressure"))
    return s.select("source", B.format_choice(F.col("rows"), F.col("sparsity"), F.col("pressure"), F.lit(1)).alias("format"), B.expected_savings(F.lit(1), F.lit(5), F.col("rows"), F.lit(3), F.lit(2)).alias("expected"))


SIZES = """SELECT source, 'tsv' AS format, sum(length(text) + 1) AS cost FROM documents GROUP BY 1 UNION ALL SELECT source, 'csv', sum(length(text) + 3) FROM documents GROUP BY 1 UNION ALL SELECT source, 'compact', sum(length(lang) + n_chars - 1) FROM documents GROUP BY 1"""


def format_costs(t):
    d = t("documents")
    one = lambda f, c: d.groupBy("source").agg(F.lit(f).alias("format"), F.sum(c).alias("cost"))
    n = F.length("text")
    return one("tsv", n + 1).unionByName(one("csv", n + 3)).unionByName(one("compact", F.length("lang") + F.col("n_chars") - 1))


@query("o09_strategy", f"SELECT source, arg_min(format, (cost, format)) AS best, min(cost)::BIGINT AS cost FROM ({SIZES}) GROUP BY 1")
def _(t):
    return B.cheapest(format_costs(t), ["source"])


@query("o10_confidence", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cost, format) AS n FROM ({SIZES})), p AS (SELECT source, min(CASE WHEN n = 1 THEN cost END)::DOUBLE AS best, min(CASE WHEN n = 2 THEN cost END)::DOUBLE AS second, min(CASE WHEN n = 1 THEN format END) AS f FROM k GROUP BY 1),
 c AS (SELECT source, f, greatest(0, least(100, floor(40.0::DOUBLE + least(20.0::DOUBLE, greatest(0.0::DOUBLE, (second - best) * 100 / second)) * 1.4::DOUBLE + CASE WHEN f = 'compact' THEN 17.5::DOUBLE ELSE 6.0::DOUBLE END + CASE WHEN f = 'tsv' THEN 12 ELSE -10 END + 0.5)))::INTEGER AS confidence FROM p)
SELECT source, confidence, CASE WHEN confidence >= 75 THEN 'high' WHEN confidence >= 55 THEN 'medium' ELSE 'low' END AS level FROM c""")
def _(t):
    k = format_costs(t).withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("cost", "format")))
    p = k.groupBy("source").agg(F.min(F.when(F.col("n") == 1, F.col("cost"))).cast("double").alias("best"), F.min(F.when(F.col("n") == 2, F.col("cost"))).cast("double").alias("second"), F.min(F.when(F.col("n") == 1, F.col("format"))).alias("f"))
    p = p.withColumn("confidence", B.confidence(F.col("best"), F.col("second"), F.lit(70.0), F.col("f") == "compact", F.col("f") == "tsv"))
    return p.select("source", "confidence", B.confidence_level(F.col("confidence")).alias("level"))


@query("o11_cap", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, CASE WHEN o_orderkey % 3 = 1 THEN 5000 END, floor(128000 * 0.4::DOUBLE))::BIGINT AS cap FROM orders")
def _(t):
    k = F.col("o_orderkey") % 3
    return t("orders").select("o_orderkey", B.token_cap(F.when(k == 0, F.col("o_custkey")), F.when(k == 1, 5000), F.lit(128000)).alias("cap"))


@query("o12_strategy_candidates", "SELECT 'csv' AS format, ceil(sum(length(s_suppkey::VARCHAR || ',' || s_name || ',' || s_nationkey::VARCHAR) + 1) / 4.0)::BIGINT AS rows_tokens FROM supplier UNION ALL SELECT 'tsv', ceil(sum(length(s_suppkey::VARCHAR || ',' || s_name || ',' || s_nationkey::VARCHAR) + 1) / 4.0)::BIGINT FROM supplier")
def _(t):
    s = t("supplier").select(F.col("s_suppkey").alias("_o"), "s_suppkey", "s_name", "s_nationkey")
    parts = [render.lines(s, f, ["_o"]).filter("part = 1").agg(F.lit(f).alias("format"), F.ceil(F.sum(F.length("line") + 1) / 4).cast("long").alias("rows_tokens")) for f in ("csv", "tsv")]
    return parts[0].unionByName(parts[1])


# Every 50th row is missing; every 7th has one of 21 leaves changed, which still matches; every 11th has two more, which does not.
GUARD = """
WITH e AS (SELECT event_id, event_id % 50 <> 0 AS there, event_id % 11 <> 0 AS alike FROM events)
SELECT count(*) AS rows, count(*) FILTER (there) AS decoded_rows, 100.0::DOUBLE AS path_pct, round(count(*) FILTER (there AND alike) * 100.0::DOUBLE / count(*), 6) AS match_pct, false AS passed, 'row count' AS reason FROM e"""


@query("o19_semantic_guard", GUARD)
def _(t):
    k = F.col("event_id")
    wide = [F.concat(F.lit(f"v{j}-"), k.cast("string")).alias(f"c{j:02d}") for j in range(20)]
    a = t("events").select(k.alias("id"), *wide)
    changed = {f"c{j:02d}": F.when(F.col("id") % m == 0, F.lit("changed")).otherwise(F.col(f"c{j:02d}")) for j, m in ((3, 7), (5, 11), (6, 11))}
    return guard.semantic_guard(a, a.filter("id % 50 <> 0").withColumns(changed))


@query("o20_reality_gate", "SELECT user_id, avg(value) >= 30 AND count(*) >= 50 AND true AND user_id % 2 = 0 AS passed FROM events GROUP BY 1")
def _(t):
    g = t("events").groupBy("user_id").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", B.reality_gate(F.col("v") + 60, F.col("n") - 35, F.lit(True), F.col("user_id") % 2 == 0).alias("passed"))


@query("o21_scorecard_gate", """
WITH l AS (SELECT event_type, arg_max(value, (ts, event_id)) AS reduction FROM events GROUP BY 1)
SELECT count(*) AS datasets, min(reduction) >= 1 AND median(reduction) >= 2 AND count(*) >= 3 AS passed FROM l""")
def _(t):
    runs = t("events").select(F.col("event_type").alias("input"), "ts", F.col("event_id").alias("id"), F.col("value").alias("reduction"))
    return telemetry.scorecard(runs, 1, 2, 3).select("datasets", "passed")


@query("j04_model_cost", f"SELECT source, model, round(sum(ceil(n_chars / 4.0)) / 1000000.0::DOUBLE * input_price, 9) AS cost FROM documents, {models_sql()} GROUP BY source, model, input_price")
def _(t):
    d = t("documents").groupBy("source").agg(F.sum(F.ceil(F.col("n_chars") / 4)).alias("tokens"))
    m = models_table(d.sparkSession)
    return d.crossJoin(F.broadcast(m)).select("source", "model", F.round(F.col("tokens") / 1e6 * F.col("input_price"), 9).alias("cost"))


@query("a23_savings_matrix", f"""
WITH s AS (SELECT format, sum(cost)::BIGINT AS tokens, 1000::BIGINT AS rows FROM ({SIZES}) GROUP BY 1)
SELECT format, model, tokens, round(tokens / 1e6::DOUBLE * input_price * 1000, 6) AS cost_per_1k, round(tokens / 1e6::DOUBLE * input_price * 1000 * 10 * 365, 4) AS annual, floor(0.5::DOUBLE * window_ / (tokens::DOUBLE / rows))::BIGINT AS rows_that_fit FROM s, {models_sql()}""")
def _(t):
    s = format_costs(t).groupBy("format").agg(F.sum("cost").alias("tokens")).withColumn("rows", F.lit(1000))
    return B.savings(s, models_table(s.sparkSession))


@query("j06_format_model_matrix", f"SELECT format, model FROM (VALUES ('csv'), ('tsv'), ('compact')) AS f(format), {models_sql()}")
def _(t):
    spark = t("region").sparkSession
    f = spark.createDataFrame([("csv",), ("tsv",), ("compact",)], "format string")
    return f.crossJoin(F.broadcast(models_table(spark).select("model")))


@query("l07_rank_models", "SELECT model, row_number() OVER (ORDER BY window_ DESC, model)::INTEGER AS rank FROM " + models_sql())
def _(t):
    m = models_table(t("region").sparkSession)
    return m.select("model", F.row_number().over(Window.orderBy(F.col("window").desc(), "model")).alias("rank"))


@query("o16_model_savings", f"SELECT model, round((sum(length('{{\"n\":\"' || n_name || '\"}}')) - sum(length(n_name)))::DOUBLE / 4 / 1000000 * input_price, 12) AS saved FROM nation, {models_sql()} GROUP BY model, input_price")
def _(t):
    n = t("nation").select(F.col("n_name").alias("n"))
    s = n.agg((F.sum(F.length(render.json_row(n, []))) - F.sum(F.length("n"))).alias("chars"))
    return s.crossJoin(models_table(n.sparkSession)).select("model", F.round(F.col("chars") / 4 / 1000000 * F.col("input_price"), 12).alias("saved"))
