"""Queries: structure statistics and dictionaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary import api
from granary.functions import scalar as S
from granary.functions.tokens import repeated_share, tokens
from granary.operators import budget as B
from granary.operators import dataset as D
from granary.operators import render, stats, telemetry
from granary.registry import query

# Rows whose keys depend on the event's type, as JSON.
SHAPED = """SELECT event_id, CASE event_type WHEN 'view' THEN '{"id":' || event_id::VARCHAR || ',"user":' || user_id::VARCHAR || '}'
 WHEN 'click' THEN '{"id":' || event_id::VARCHAR || ',"page":"p"}' ELSE '{"id":' || event_id::VARCHAR || ',"user":' || user_id::VARCHAR || ',"kind":"' || event_type || '"}' END AS doc FROM events"""


def shaped(t):
    e = t("events")
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    view = F.concat(F.lit('{"id":'), i, F.lit(',"user":'), u, F.lit("}"))
    click = F.concat(F.lit('{"id":'), i, F.lit(',"page":"p"}'))
    other = F.concat(F.lit('{"id":'), i, F.lit(',"user":'), u, F.lit(',"kind":"'), F.col("event_type"), F.lit('"}'))
    return e.select("event_id", F.when(F.col("event_type") == "view", view).when(F.col("event_type") == "click", click).otherwise(other).alias("doc"))


@query("p11_row_shapes", f"""
WITH d AS ({SHAPED}), k AS (SELECT event_id, array_to_string(list_sort(json_keys(doc)), ',') AS fields FROM d), g AS (SELECT fields, min(event_id) AS first, count(*) AS rows FROM k GROUP BY 1)
SELECT (row_number() OVER (ORDER BY first) - 1)::INTEGER AS shape_id, fields, rows FROM g""")
def _(t):
    return D.row_shapes(shaped(t), "doc", "event_id").select("shape_id", F.array_join("fields", ",").alias("fields"), "rows")


@query("p09_value_kinds", f"""
WITH d AS ({SHAPED}), k AS (SELECT doc, unnest(json_keys(doc)) AS key FROM d)
SELECT key, CASE json_type(doc, '$.' || key) WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, count(*) AS n FROM k GROUP BY 1, 2""")
def _(t):
    k = shaped(t).select("doc", F.explode(F.json_object_keys("doc")).alias("key"))
    kind = F.expr("CASE schema_of_variant(try_variant_get(parse_json(doc), concat('$.', key), 'variant')) WHEN 'STRING' THEN 'string' ELSE 'number' END")
    return k.select("key", kind.alias("kind")).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("p10_column_types", "SELECT 'num' AS o_custkey, 'str?' AS s, 'bool' AS big, 'str?' AS never, 'num[]' AS arr FROM region LIMIT 1")
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("O")).alias("s"), (F.col("o_totalprice") > 1000).alias("big"), F.lit(None).cast("int").alias("never"), F.array("o_custkey").alias("arr"))
    return render.record_types(o, ["o_orderkey"])


@query("p17_leaves", "SELECT (SELECT count(*) FROM customer) * 4 + (SELECT count(*) FROM nation) * 0 AS leaves, (SELECT count(DISTINCT c_name) FROM customer) AS names")
def _(t):
    m = D.melt(t("customer"), ["c_custkey"])
    return m.agg(F.count("value").alias("leaves"), F.countDistinct(F.when(F.col("field") == "c_name", F.col("value"))).alias("names"))


@query("p18_leaf_pairs", "SELECT count(DISTINCT 'n_name=' || n_name) + count(DISTINCT 'n_regionkey=' || n_regionkey::VARCHAR) AS pairs FROM nation")
def _(t):
    m = D.melt(t("nation"), ["n_nationkey"])
    return m.select(F.concat_ws("=", "field", "value").alias("p")).agg(F.countDistinct("p").alias("pairs"))


@query("p20_entropy_order", """
WITH m AS (SELECT 'c_mktsegment' AS field, c_mktsegment AS v FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer UNION ALL SELECT 'c_name', c_name FROM customer),
 c AS (SELECT field, v, count(*) AS n FROM m GROUP BY 1, 2), p AS (SELECT field, n::DOUBLE / sum(n) OVER (PARTITION BY field) AS p FROM c), e AS (SELECT field, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY 1)
SELECT field, entropy, row_number() OVER (ORDER BY entropy DESC, field)::INTEGER AS rank FROM e""")
def _(t):
    e = stats.column_entropy(t("customer").drop("c_acctbal"), ["c_custkey"])
    return e.select("field", F.round("entropy", 6).alias("entropy"), "rank")


@query("a05_constant_cols", "SELECT 'k' AS field, 'same' AS value UNION ALL SELECT 'n', NULL")
def _(t):
    return stats.constant_columns(t("supplier").select("s_suppkey", "s_name", F.lit("same").alias("k"), F.lit(None).cast("string").alias("n")), ["s_suppkey"])


@query("a06_template_cols", """
WITH m AS (SELECT c_name, c_custkey::VARCHAR AS k, strpos('user-' || c_custkey::VARCHAR || '@x', c_custkey::VARCHAR) AS place FROM customer)
SELECT 'mail' AS field, 'c_custkey' AS source, min(left('user-' || k || '@x', place - 1)) AS prefix, min(substr('user-' || k || '@x', place + length(k))) AS suffix FROM m""")
def _(t):
    c = t("customer").select(F.col("c_custkey").alias("_o"), "c_custkey", "c_mktsegment", F.concat(F.lit("user-"), F.col("c_custkey").cast("string"), F.lit("@x")).alias("mail"))
    p = render.compact_plan(c, ["_o"])[1]
    return c.sparkSession.createDataFrame([(k, *v) for k, v in p.templates.items()], "field string, source string, prefix string, suffix string")


@query("a07_common_prefix", """
WITH m AS (SELECT min(c_name) AS lo, max(c_name) AS hi, count(*) AS texts FROM customer WHERE length(c_name) > 10)
SELECT 'c_name' AS field, texts, left(lo, (SELECT max(k) FROM range(1, 50) r(k) WHERE left(lo, k) = left(hi, k))) AS prefix FROM m""")
def _(t):
    return stats.common_prefixes(t("customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("a08_sparsity", "SELECT count(*) * 2 AS cells, count(*) FILTER (o_orderstatus = 'O') + count(*) FILTER (o_orderpriority = '5-LOW') AS empty, round((count(*) FILTER (o_orderstatus = 'O') + count(*) FILTER (o_orderpriority = '5-LOW'))::DOUBLE / (count(*) * 2), 9) AS ratio FROM orders")
def _(t):
    o = t("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("").alias("p"))
    return stats.sparsity(o, ["o_orderkey"])


@query("a01_record_dict", """
WITH m AS (SELECT o_orderkey, 0 AS k, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 1, o_orderpriority FROM orders)
SELECT value, count(*) AS uses FROM m GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    return render.record_dictionary(t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])


@query("a02_compact_dict", """
WITH c AS (SELECT p_name AS value, count(*) AS uses FROM part WHERE length(p_name) > 2 GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part WHERE length(p_type) > 2 GROUP BY 1),
 g AS (SELECT value, sum(uses)::BIGINT AS uses FROM c GROUP BY 1), s AS (SELECT least(count(*), 10000) AS size FROM g)
SELECT value, uses FROM g, s WHERE uses >= 2 AND uses * (length(value) - 1 - length(size::VARCHAR)) > length(value) + 1""")
def _(t):
    p = t("part").select("p_partkey", "p_name", "p_type")
    return render.compact_dictionary(p, ["p_partkey"], render.CompactPlan(["p_name", "p_type"], active=["p_name", "p_type"]))


@query("a03_token_dict", None)
def _(t):
    cells = D.melt(t("part").select("p_partkey", "p_name", "p_type"), ["p_partkey"]).groupBy("value").agg(F.count(F.lit(1)).alias("uses"))
    g = cells.withColumn("ids", tokens(F.col("value"))).withColumn("n", F.size("ids"))
    return g.filter("uses * n > n + uses").select("value", "uses", "n", (F.row_number().over(Window.orderBy(F.col("uses").desc(), "value")) - 1).alias("ref"))


@query("a09_structure", f"""
WITH d AS ({SHAPED}), k AS (SELECT doc, unnest(json_keys(doc)) AS p FROM d), f AS (SELECT p, count(*) AS n, count(DISTINCT json_extract_string(doc, '$.' || p)) AS kinds FROM k GROUP BY 1), r AS (SELECT count(*) AS rows FROM d),
 m AS (SELECT max(len(json_keys(doc))) AS most FROM d)
SELECT rows, count(*) AS fields, round(count(*) FILTER (n = rows) * 100.0::DOUBLE / count(*), 6) AS consistency_pct, round(count(*) FILTER (n < rows) * 100.0::DOUBLE / count(*), 6) AS optional_pct,
 round(sum(n)::DOUBLE / rows, 6) AS fields_per_row, most::BIGINT AS most_fields, round(1.0::DOUBLE / rows, 9) AS repetition_ratio_ref, round(sum(kinds)::DOUBLE / sum(n), 6) AS repetition_ratio FROM f, r, m GROUP BY rows, most""")
def _(t):
    return stats.structure(shaped(t), "doc")


@query("a10_benefit_score", """
WITH p AS (SELECT p_partkey, (p_size * 40)::BIGINT AS rows, (p_partkey % 101)::DOUBLE AS c, (100 - p_partkey % 101)::DOUBLE AS o, (p_size / 50.0)::DOUBLE AS r, (p_partkey % 6)::BIGINT AS d FROM part),
 s AS (SELECT *, least(100.0::DOUBLE, least(30.0::DOUBLE, c * 0.3::DOUBLE) + CASE WHEN r < 0.5 THEN 25 WHEN r < 0.7 THEN 15 WHEN r < 0.9 THEN 5 ELSE 0 END + CASE WHEN rows > 1000 THEN 20 WHEN rows > 100 THEN 15 WHEN rows > 10 THEN 5 ELSE 0 END
  + CASE WHEN o < 10 THEN 15 WHEN o < 30 THEN 10 ELSE 0 END + CASE WHEN d <= 2 THEN 10 WHEN d <= 4 THEN 5 ELSE 0 END) AS score FROM p)
SELECT p_partkey, round(score, 6) AS score, CASE WHEN score >= 60 AND c >= 80 THEN 'token_binary' WHEN score >= 50 AND r < 0.5 THEN 'token_binary' WHEN d > 4 THEN 'markdown' WHEN c < 50 THEN CASE WHEN score >= 40 THEN 'token_binary' ELSE 'csv' END
 WHEN rows < 5 THEN 'json' WHEN score >= 25 THEN 'token_binary' ELSE 'csv' END AS strategy FROM s""")
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    p = t("part").select("p_partkey", (size * 40).cast("long").alias("rows"), (k % 101).cast("double").alias("c"), (100 - k % 101).cast("double").alias("o"), (size / 50).alias("r"), (k % 6).alias("d"))
    p = p.withColumn("score", stats.benefit_score(F.col("rows"), F.col("c"), F.col("o"), F.col("r"), F.col("d")))
    return p.select("p_partkey", F.round("score", 6).alias("score"), stats.strategy(F.col("score"), F.col("c"), F.col("r"), F.col("d"), F.col("rows")).alias("strategy"))


@query("a11_complexity", """
WITH r AS (SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'O') AS nulls FROM orders)
SELECT rows, round(log2(3.0::DOUBLE), 6) AS entropy, 1 AS depth, round(least(1.0::DOUBLE, 1.0::DOUBLE / rows), 9) AS polymorphism, 2 AS kinds, 0.0::DOUBLE AS array_complexity, round(nulls::DOUBLE / (rows * 3), 9) AS sparsity,
 floor(log2(3.0::DOUBLE) / 5 * 25 + 1.0 / 6 * 20 + 15.0 / rows + 2.0 / 7 * 15 + least(10.0, nulls::DOUBLE / (rows * 3) * 20) + 0.5)::INTEGER AS score,
 CASE WHEN floor(log2(3.0::DOUBLE) / 5 * 25 + 1.0 / 6 * 20 + 15.0 / rows + 2.0 / 7 * 15 + least(10.0, nulls::DOUBLE / (rows * 3) * 20) + 0.5) >= 20 THEN 'simple' ELSE 'trivial' END AS class FROM r""")
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("O")).alias("s"), "o_orderpriority")
    return stats.complexity(o, ["o_orderkey"])


@query("a12_repetition", """
WITH m AS (SELECT p_name AS v FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part), c AS (SELECT v, count(*) AS n FROM m GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS total FROM c)
SELECT count(*) AS distinct_texts, total AS texts, round(1 - count(*)::DOUBLE / total, 9) AS reuse, round(sum(n * length(v))::DOUBLE / total, 6) AS mean_length, round(sum(-(n::DOUBLE / total) * log2(n::DOUBLE / total)), 6) AS entropy FROM c, s GROUP BY total""")
def _(t):
    return stats.repetition(t("part"), ["p_partkey"])


@query("a12_repeated_tokens", None)
def _(t):
    return repeated_share(t("conversations"), "text")


@query("a21_shape_consistency", f"""
WITH d AS ({SHAPED}), k AS (SELECT event_id, json_keys(doc) AS k FROM d), f AS (SELECT arg_min(k, event_id) AS k0 FROM k)
SELECT round(avg(len(list_intersect(k, k0))::DOUBLE / len(list_distinct(list_concat(k, k0)))), 9) AS consistency FROM k, f""")
def _(t):
    return stats.shape_consistency(shaped(t), "doc", "event_id")


@query("a04_string_table", """
WITH m AS (SELECT n_nationkey * 2 AS pos, n_name AS s FROM nation UNION ALL SELECT n_nationkey * 2 + 1, left(n_name, 6) FROM nation), f AS (SELECT s, min(pos) AS first FROM m GROUP BY 1)
SELECT s, (row_number() OVER (ORDER BY first) - 1)::INTEGER AS id FROM f""")
def _(t):
    m = t("nation").select(F.posexplode(F.array("n_name", F.left("n_name", F.lit(6)))).alias("j", "s"), "n_nationkey")
    return stats.string_table(m, ["n_nationkey", "j"])


@query("a15_marginal_cost", """
WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, ceil(length(o_orderkey::VARCHAR || ',' || o_orderstatus) / 4.0) AS tok FROM orders), s AS (SELECT n, sum(tok) OVER (ORDER BY n) AS upto FROM l),
 p AS (SELECT n, upto, lead(n) OVER (ORDER BY n) AS n2, lead(upto) OVER (ORDER BY n) AS up2 FROM s WHERE n IN (100, 500, 1000, 5000))
SELECT n AS from_rows, n2 AS to_rows, round((up2 - upto)::DOUBLE / (n2 - n), 6) AS tokens_per_row FROM p WHERE n2 IS NOT NULL""")
def _(t):
    o = D.ordered(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    o = o.select((F.col("_ord") + 1).alias("n"), S.token_estimate(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus")).alias("tok"))
    return B.marginal_cost(o, "n", "tok", [100, 500, 1000, 5000])


@query("a16_structural_overhead", """
SELECT sum(ceil((length(p_name) + length(p_brand) + 26) / 4.0))::BIGINT AS total, sum(ceil(length(p_name) / 4.0) + ceil(length(p_brand) / 4.0))::BIGINT AS values_,
 round(1 - sum(ceil(length(p_name) / 4.0) + ceil(length(p_brand) / 4.0))::DOUBLE / sum(ceil((length(p_name) + length(p_brand) + 26) / 4.0)), 9) AS overhead FROM part""")
def _(t):
    p = t("part").select("p_partkey", F.col("p_name").alias("name_"), F.col("p_brand").alias("brand"))
    own = S.token_estimate(F.col("name_")) + S.token_estimate(F.col("brand"))
    g = p.agg(F.sum(S.token_estimate(F.concat(render.json_row(p, ["p_partkey"]), F.lit("\n  ")))).alias("total"), F.sum(own).alias("values_"))
    return g.withColumn("overhead", F.round(1 - F.col("values_") / F.col("total"), 9))


@query("a17_width_sensitivity", """
WITH l AS (SELECT p_name || ',' || p_brand || ',' || p_type AS a, p_name || ',' || p_brand AS b, p_name AS c FROM part)
SELECT 1 AS width, sum(octet_length(encode(c)))::BIGINT AS bytes FROM l UNION ALL SELECT 2, sum(octet_length(encode(b)))::BIGINT FROM l UNION ALL SELECT 3, sum(octet_length(encode(a)))::BIGINT FROM l""")
def _(t):
    return stats.width_sensitivity(t("part"), ["p_name", "p_brand", "p_type"])


LINES = "p_brand || ',' || p_name || ',' || p_type"


@query("a19_entropy_correlation", f"""
WITH m AS (SELECT p_name AS v FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part), c AS (SELECT v, count(*) AS n FROM m GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS total FROM c),
 r AS (SELECT round(1 - count(*)::DOUBLE / total, 9) AS reuse, round(sum(-(n::DOUBLE / total) * log2(n::DOUBLE / total)), 6) AS entropy FROM c, s GROUP BY total),
 l AS (SELECT sum(length({LINES}) + 1) AS plain, sum(length({LINES}) + length('{{"p_brand":"","p_name":"","p_type":""}}') - 2 + 1) AS braces FROM part),
 f AS (SELECT 'csv' AS format, ceil((plain + length('p_brand,p_name,p_type') + 1 - 1) / 4.0)::BIGINT AS tokens FROM l UNION ALL SELECT 'json_min', ceil((braces + 1) / 4.0)::BIGINT FROM l)
SELECT format, entropy, reuse, tokens, round(tokens::DOUBLE / (SELECT tokens FROM f WHERE format = 'json_min'), 4) AS tokens_vs_json FROM f, r""")
def _(t):
    return stats.entropy_correlation(t("part").select("p_partkey", "p_brand", "p_name", "p_type"), ["p_partkey"], ("csv", "json_min"))


@query("a20_encoding_stats", None)
def _(t):
    return api.encoding_stats(t("part").select("p_partkey", "p_brand", "p_type"), ["p_partkey"])


@query("a24_efficiency", """
WITH e AS (SELECT user_id, least(30.0::DOUBLE, avg(value) / 1000 / 10 * 30) + least(30.0::DOUBLE, (1 - 0.4::DOUBLE) / 0.6::DOUBLE * 30) + 20 + 10 AS score FROM events GROUP BY 1)
SELECT user_id, round(score, 6) AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM e""")
def _(t):
    e = t("events").groupBy("user_id").agg((F.avg("value") / 1000).alias("mb"))
    e = e.withColumn("s", telemetry.efficiency(F.col("mb"), F.lit(0.4), F.lit(20), F.lit(10)))
    return e.select("user_id", F.round("s", 6).alias("score"), telemetry.grade(F.col("s")).alias("grade"))


@query("a25_benchmark_summary", "SELECT p_type, round(avg(p_size), 6) AS avg_, max(p_size) AS max_, min(p_size) AS min_, median(p_size)::DOUBLE AS p50 FROM part GROUP BY 1")
def _(t):
    return stats.summary(t("part"), ["p_type"], "p_size")
