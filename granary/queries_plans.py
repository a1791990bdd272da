"""Queries: mini-query, sort and limit, joins, datasets, stores, sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import scalar as S
from granary.operators import dataset as D
from granary.operators import guard, session, stats, store, telemetry
from granary.operators.budget import cache_control, cache_outcome
from granary.plans.miniquery import filter_text, parse, predicate, select_rows, sort_stable
from granary.registry import query
from granary.sources import files

MINI = [
    ("f02_eq_string", "customer", "c_mktsegment = MACHINERY", "c_mktsegment = 'MACHINERY'"),
    ("f02_eq_number", "customer", "c_nationkey = 7", "c_nationkey = 7"),
    ("f03_neq", "orders", "o_orderstatus != F", "o_orderstatus <> 'F'"),
    ("f04_gt", "orders", "o_totalprice > 250000", "o_totalprice > 250000"),
    ("f05_lt", "part", "p_size < 10", "p_size < 10"),
    ("f06_gte", "customer", "c_acctbal >= 5000.5", "c_acctbal >= 5000.5"),
    ("f07_lte", "supplier", "s_acctbal <= 0", "s_acctbal <= 0"),
    ("f08_unknown_op", "orders", "o_orderstatus ~~ O", "o_orderstatus = 'O'"),
]
for _name, _table, _where, _sql in MINI:

    @query(_name, f"SELECT * FROM {_table} WHERE {_sql}")
    def _mini(t, table=_table, where=_where):
        return select_rows(t(table), parse(f"GET {table} WHERE {where}"), [])


@query("f09_missing_field", "SELECT count(*) AS n FROM orders WHERE 0 >= 0")
def _(t):
    return filter_text(t("orders"), "no_such_field >= 0").agg(F.count(F.lit(1)).alias("n"))


@query("f04_null_is_zero", """
WITH p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS size, nullif(p_type, (SELECT min(p_type) FROM part)) AS kind FROM part)
SELECT p_partkey, size, kind FROM p WHERE coalesce(size, 0) < 5 OR (kind IS NULL AND size > 20)""")
def _(t):
    part = t("part")
    low = part.agg(F.min("p_type").alias("lo"))
    p = part.crossJoin(F.broadcast(low)).select("p_partkey", F.when(F.col("p_size") <= 25, F.col("p_size")).alias("size"), F.nullif("p_type", "lo").alias("kind"))
    return p.filter(predicate(p, "size", "<", "5") | (predicate(p, "size", ">", "20") & p["kind"].isNull()))


@query("f03_null_passes", "SELECT count(*) AS n FROM (SELECT nullif(o_orderstatus, 'O') AS s FROM orders) WHERE coalesce(s, '') <> 'F'")
def _(t):
    df = t("orders").select(F.nullif("o_orderstatus", F.lit("O")).alias("s"))
    return filter_text(df, "s != F").agg(F.count(F.lit(1)).alias("n"))


@query("f10_filter_string", "SELECT event_id, user_id FROM events WHERE user_id > 100")
def _(t):
    return filter_text(t("events"), "user_id > 100").select("event_id", "user_id")


RECORDS = "SELECT event_id AS id, ts, event_type AS operation, event_type IN ('view', 'click') AS hit, CASE event_type WHEN 'error' THEN 'corrupt' WHEN 'signup' THEN 'cold' WHEN 'purchase' THEN 'changed' END AS reason, user_id AS key, value AS latency FROM events"


def records(t):
    e = t("events")
    reason = F.when(F.col("event_type") == "error", "corrupt").when(F.col("event_type") == "signup", "cold").when(F.col("event_type") == "purchase", "changed")
    return e.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("operation"), F.col("event_type").isin("view", "click").alias("hit"), reason.alias("reason"), F.col("user_id").alias("key"), F.col("value").alias("latency"))


@query("f11_cache_filter", f"SELECT id, key FROM ({RECORDS}) WHERE operation = 'error' AND NOT hit AND reason = 'corrupt' AND ts >= TIMESTAMP '2024-01-10 00:00:00'")
def _(t):
    return telemetry.record_filter(records(t), operation="error", hit=False, reason="corrupt", since=F.lit("2024-01-10 00:00:00").cast("timestamp")).select("id", "key")


@query("f12_report_filter", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' AND user_id = 3 GROUP BY user_id")
def _(t):
    df = filter_text(filter_text(t("events"), "event_type = view"), "user_id = 3")
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("l01_limit", "SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 100")
def _(t):
    return select_rows(t("customer"), parse("GET customer WHERE c_mktsegment = MACHINERY LIMIT 100"), ["c_custkey"])


@query("l01_limit_zero", "SELECT count(*) AS n FROM supplier")
def _(t):
    return select_rows(t("supplier"), parse("GET supplier LIMIT 0"), ["s_suppkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("l02_sort_nulls_last_desc", """
SELECT o_orderkey, p, (row_number() OVER (ORDER BY p DESC NULLS LAST, o_orderkey) - 1)::BIGINT AS pos
FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders)""")
def _(t):
    df = t("orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return sort_stable(df, "p", ["o_orderkey"], True, place="pos")


@query("l06_top_candidates", "SELECT p_name AS value, count(*) AS uses FROM part GROUP BY 1 ORDER BY count(*) * length(p_name) DESC, min(p_partkey) LIMIT 20")
def _(t):
    return stats.top_candidates(t("part"), "p_name", "p_partkey", 20)


@query("l08_max_documents", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 500")
def _(t):
    return files.load_documents(t("documents"), "doc_id", "text", 500).select(F.col("_id").alias("doc_id"))


# Joins inside algorithms.


@query("j01_delta_rows", """
SELECT user_id, event_type, event_id FROM events n WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND NOT EXISTS
 (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-20 00:00:00' AND o.user_id = n.user_id AND o.event_type = 'purchase' AND o.user_id % 3 = 0)""")
def _(t):
    e, at = t("events"), F.lit("2024-01-20 00:00:00").cast("timestamp")
    return session.delta_rows(e.filter(F.col("ts") >= at), e.filter((F.col("ts") < at) & (F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0)), "user_id").select("user_id", "event_type", "event_id")


@query("j02_store_once", "SELECT sha256(text) AS hash, count(*) AS copies, octet_length(encode(min(text)))::BIGINT AS bytes FROM documents GROUP BY 1")
def _(t):
    return store.hashed(t("documents").select(F.col("text").alias("body"), F.lit(1).cast("long").alias("rows"))).select("hash", "copies", "bytes")


def stored(t, docs):
    """A new store with the texts of docs."""
    spark = docs.sparkSession
    made = store.ContentStore(spark, files.scratch(spark, "store"))
    made.put(docs.select(F.col("text").alias("body"), F.lit(1).cast("long").alias("rows")))
    return made


@query("s09_store_put", "SELECT DISTINCT sha256(text) AS hash, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def _(t):
    kept = stored(t, t("documents"))
    return kept.blobs().select("hash", "bytes")


@query("s13_peek_new", """
SELECT sha256(d.text) AS hash, min(doc_id) AS doc_id FROM documents d WHERE doc_id % 2 = 1
AND NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 2 = 0 AND k.text = d.text) GROUP BY 1""")
def _(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    new = d.filter("doc_id % 2 = 1").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    return store.store_once(new, d.filter("doc_id % 2 = 0"), "hash").select("hash", "doc_id")


@query("j03_guard_match", """
WITH a AS (SELECT user_id::VARCHAR || ':' || event_type AS f, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
 b AS (SELECT user_id::VARCHAR || ':' || event_type AS f, count(*) AS n FROM events WHERE event_id % 3 <> 1 GROUP BY 1)
SELECT sum(least(a.n, b.n))::BIGINT AS matched, (SELECT sum(n) FROM a)::BIGINT AS rows, (SELECT sum(n) FROM b)::BIGINT AS decoded_rows FROM a JOIN b ON a.f = b.f""")
def _(t):
    e = t("events").select("event_id", F.struct("user_id", "event_type").alias("f"))
    return guard.matched_rows(e.filter("event_id % 3 <> 0").select("f"), e.filter("event_id % 3 <> 1").select("f"))


@query("j05_dictionary_substitution", """
WITH d AS (SELECT p_type, '@' || (row_number() OVER (ORDER BY count(*) DESC, p_type) - 1)::VARCHAR AS ref FROM part GROUP BY p_type)
SELECT p_partkey, ref FROM part JOIN d USING (p_type)""")
def _(t):
    p = t("part")
    d = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("c")).withColumn("ref", F.concat(F.lit("@"), (F.row_number().over(Window.orderBy(F.col("c").desc(), "p_type")) - 1).cast("string")))
    return p.join(d, "p_type").select("p_partkey", "ref")


@query("j08_path_overlap", """
WITH a AS (SELECT DISTINCT unnest(json_keys(props)) AS p FROM events WHERE event_type = 'view' UNION SELECT 'extra'),
 b AS (SELECT DISTINCT unnest(json_keys(props)) AS p FROM events)
SELECT (SELECT count(*) FROM a) AS paths, (SELECT count(*) FROM a JOIN b USING (p)) AS covered""")
def _(t):
    e = t("events").select("event_type", F.explode(F.json_object_keys("props")).alias("p"))
    a = e.filter("event_type = 'view'").select("p").union(e.sparkSession.createDataFrame([("extra",)], "p string"))
    return stats.path_overlap(a, e)


# Windows.


@query("w01_prefix_overlap_chars", """
WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, CASE WHEN prev IS NULL THEN 0 ELSE coalesce((SELECT max(k) FROM range(1, 1 + least(length(text), length(prev))) r(k) WHERE left(text, k) = left(prev, k)), 0) END::BIGINT AS shared FROM c""")
def _(t):
    c = t("conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.coalesce(F.length(S.common_prefix(F.col("text"), F.col("prev"))), F.lit(0)).cast("long").alias("shared"))


@query("w02_latest_per_key", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(t):
    return telemetry.latest_per_key(t("events"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("w03_prev_delta", """
SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events""")
def _(t):
    df = t("events").withColumn("v", F.col("event_id"))
    return telemetry.previous_delta(df, "user_id", ["ts", "event_id"], "v").select("event_id", "previous", "delta")


@query("w04_delta", """
SELECT l_orderkey, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = 1 THEN a[1] ELSE a[i] - a[i - 1] END)::VARCHAR AS deltas
FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY 1)""")
def _(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("s"))
    a = F.transform("s", lambda x: x["l_partkey"])
    g = g.select("l_orderkey", S.delta_encode(a).alias("d"))
    return g.select("l_orderkey", F.concat(F.lit("["), F.array_join(F.transform("d", lambda x: x.cast("string")), ", "), F.lit("]")).alias("deltas"))


@query("w05_rle", """
WITH r AS (SELECT l_orderkey, l_returnflag AS v, row_number() OVER w - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice, l_quantity, l_shipdate) AS g, row_number() OVER w AS k
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice, l_quantity, l_shipdate)),
 s AS (SELECT l_orderkey, v, g, count(*) AS n, min(k) AS k FROM r GROUP BY 1, 2, 3)
SELECT l_orderkey, string_agg(v || n::VARCHAR, ' ' ORDER BY k) AS runs FROM s GROUP BY 1""")
def _(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("s"))
    r = S.run_lengths(F.transform("s", lambda x: x["l_returnflag"]), "string")
    return g.select("l_orderkey", F.array_join(F.transform(r, lambda x: F.concat(x["v"], x["n"].cast("string"))), " ").alias("runs"))


@query("w06_array_plan", """
WITH a AS (SELECT l_orderkey, list(l_linenumber::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey) AS x, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN x = list_sort(x) THEN 'delta' WHEN len(list_distinct(x)) < len(x) * 0.5 THEN 'dict' ELSE 'none' END AS lines,
 CASE WHEN len(y) > len(list_distinct(y)) * 1.5 AND y = list_sort(y) THEN 'rle' WHEN len(list_distinct(y)) < len(y) * 0.5 THEN 'dict' ELSE 'none' END AS flags FROM a""")
def _(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("s"))
    return g.select("l_orderkey", S.array_plan(F.transform("s", lambda x: x["l_linenumber"]), True).alias("lines"), S.array_plan(F.transform("s", lambda x: x["l_returnflag"]), False).alias("flags"))


# Changes of a dataset.
_M = "SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) AS pos, s_suppkey, s_name FROM supplier"


def _suppliers(t):
    return D.ordered(t("supplier").select("s_suppkey", "s_name"), "s_suppkey").select(F.col("_ord").alias("pos"), "s_suppkey", "s_name")


@query("m01_append", f"WITH m AS ({_M}) SELECT * FROM m UNION ALL SELECT (SELECT count(*) FROM m), -1, s_name FROM m WHERE pos = 0")
def _(t):
    return D.mutated(_suppliers(t), "pos", "append", t("supplier").count(), {"s_suppkey": F.lit(-1).cast("long")})


@query("m01_delete_middle", f"WITH m AS ({_M}), h AS (SELECT count(*) // 2 AS mid FROM m) SELECT CASE WHEN pos > mid THEN pos - 1 ELSE pos END AS pos, s_suppkey, s_name FROM m, h WHERE pos <> mid")
def _(t):
    return D.mutated(_suppliers(t), "pos", "delete", t("supplier").count())


@query("m01_insert_middle", f"WITH m AS ({_M}), h AS (SELECT count(*) // 2 AS mid FROM m) SELECT CASE WHEN pos >= mid THEN pos + 1 ELSE pos END AS pos, s_suppkey, s_name FROM m, h UNION ALL SELECT mid, -1, s_name FROM m, h WHERE pos = 0")
def _(t):
    return D.mutated(_suppliers(t), "pos", "insert", t("supplier").count(), {"s_suppkey": F.lit(-1).cast("long")})


@query("m01_update_middle", f"WITH m AS ({_M}), h AS (SELECT count(*) // 2 AS mid FROM m) SELECT pos, s_suppkey, CASE WHEN pos = mid THEN 'changed' ELSE s_name END AS s_name FROM m, h")
def _(t):
    return D.mutated(_suppliers(t), "pos", "update", t("supplier").count(), {"s_name": F.lit("changed")})


@query("m01_prepend", f"WITH m AS ({_M}) SELECT pos + 1 AS pos, s_suppkey, s_name FROM m UNION ALL SELECT 0, -1, s_name FROM m WHERE pos = 0")
def _(t):
    return D.mutated(_suppliers(t), "pos", "prepend", 0, {"s_suppkey": F.lit(-1).cast("long")})


# Sessions.


@query("z01_incremental", """
WITH f AS (SELECT user_id, min(date_trunc('day', ts)) AS d FROM events GROUP BY 1)
SELECT day(d)::INTEGER AS day_, count(*) AS new_users FROM f GROUP BY 1""")
def _(t):
    f = t("events").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("d"))
    return f.groupBy(F.dayofmonth("d").alias("day_")).agg(F.count(F.lit(1)).alias("new_users"))


@query("z02_session_dedup", """
WITH v AS (SELECT DISTINCT conv_id AS batch, role AS value FROM conversations UNION SELECT DISTINCT conv_id, text FROM conversations WHERE text <> ''),
 k AS (SELECT batch, value, row_number() OVER (PARTITION BY value ORDER BY batch) > 1 AS known FROM v),
 g AS (SELECT batch, count(*) FILTER (known) AS dict_hits, count(*) FILTER (NOT known) AS new_entries, sum(CASE WHEN known THEN greatest(0, ceil(length(value) / 4.0)::BIGINT - 1) ELSE 0 END) AS vs FROM k GROUP BY 1),
 s AS (SELECT batch, row_number() OVER (ORDER BY batch) > 1 AS schema_known FROM g)
SELECT batch, schema_known, dict_hits, new_entries, (vs + CASE WHEN schema_known THEN ceil(length('@schema data conv_id role text turn') / 4.0) ELSE 0 END)::BIGINT AS saved FROM g JOIN s USING (batch)""")
def _(t):
    c = t("conversations").select(F.col("conv_id").alias("batch"), "role", "text")
    values = c.select("batch", F.explode(F.array("role", "text")).alias("value"))
    schemas = c.select("batch").distinct().withColumn("signature", F.lit("conv_id,role,text,turn"))
    return session.session_savings(values, schemas, "batch").select("batch", "schema_known", "dict_hits", "new_entries", F.col("saved").cast("long").alias("saved"))


@query("z04_bounded_log", "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(t):
    return telemetry.last_records(records(t), 1000).select("id")


# Telemetry.


@query("a13_cache_telemetry", f"SELECT count(*) AS total, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(CASE WHEN hit THEN 100.0::DOUBLE ELSE 0 END), 6) AS hit_pct, min(ts) AS since FROM ({RECORDS})")
def _(t):
    return telemetry.cache_summary(records(t)).select("total", "hits", "misses", "hit_pct", "since")


@query("a13_by_reason", f"SELECT reason, count(*) AS n, count(*) FILTER (hit) AS hits FROM ({RECORDS}) GROUP BY reason")
def _(t):
    return telemetry.counts_by(records(t), "reason")


@query("a13_by_operation", f"SELECT operation, count(*) AS n, count(*) FILTER (hit) AS hits FROM ({RECORDS}) GROUP BY operation")
def _(t):
    return telemetry.counts_by(records(t), "operation")


@query("a13_percentiles", f"""
WITH s AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS k, count(*) OVER () AS n FROM ({RECORDS})), p AS (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS p)
SELECT p, latency FROM s, p WHERE k = least(floor(n * p)::BIGINT, n - 1)""")
def _(t):
    return telemetry.latency_percentiles(records(t))


@query("a13_hourly", f"SELECT date_trunc('hour', ts) AS start, operation, count(*) AS total, count(*) FILTER (hit) AS hits FROM ({RECORDS}) GROUP BY 1, 2")
def _(t):
    w = records(t).groupBy(F.window("ts", "1 hour").alias("w"), "operation").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("hit"), 1)).alias("hits"))
    return w.select(F.col("w.start").alias("start"), "operation", "total", "hits")


@query("a14_scorecard", """
WITH l AS (SELECT user_id, arg_max((event_id * 7919) % 101, (ts, event_id)) AS reduction FROM events GROUP BY 1)
SELECT count(*) AS datasets, min(reduction) AS floor, median(reduction)::DOUBLE AS median, min(reduction) >= 35 AND median(reduction) >= 60 AND count(*) >= 3 AS passed FROM l""")
def _(t):
    runs = t("events").select(F.col("user_id").alias("input"), "ts", F.col("event_id").alias("id"), (F.col("event_id") * 7919 % 101).alias("reduction"))
    return telemetry.scorecard(runs)


@query("o18_cache_class", "SELECT CASE WHEN value > 50 THEN CASE WHEN user_id % 2 = 0 THEN 'provider_and_local_hit' ELSE 'provider_hit' END WHEN user_id % 2 = 0 THEN 'local_hit' WHEN event_type IN ('json', 'none') THEN 'not_cacheable' ELSE 'miss' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def _(t):
    e = t("events").select(cache_outcome(F.col("event_type"), F.when(F.col("value") > 50, 1).otherwise(0), F.col("user_id") % 2 == 0).alias("outcome"))
    return e.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("s22_snapshot_log", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS last_run, count(*) AS runs FROM events GROUP BY 1, 2")
def _(t):
    return files.latest_runs(t("events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")


# Adapters and prompts.


@query("s24_document_loader", "SELECT (row_number() OVER (ORDER BY doc_id) - 1) AS _index, doc_id AS _id, text AS _content, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\",\"n_chars\":' || n_chars::VARCHAR || '}' AS _metadata FROM documents")
def _(t):
    return files.load_documents(t("documents"), "doc_id", "text")


@query("r17_last_message", "SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def _(t):
    return files.last_row_text(t("conversations"), "conv_id", "turn", "role", "text")


@query("i01_placeholders", """
WITH d AS (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) AS doc FROM region), p AS (SELECT doc_id, text || ' {{DATA:' || CASE doc_id % 3 WHEN 0 THEN 'regions' WHEN 1 THEN 'status' ELSE 'unknown' END || '}}' AS prompt FROM documents)
SELECT doc_id, replace(replace(prompt, '{{DATA:regions}}', doc), '{{DATA:status}}', 'ok') AS prompt, length(prompt) > 60 AS long_ FROM p, d""")
def _(t):
    spark = t("region").sparkSession
    doc = t("region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]), ",").alias("document")).select(F.lit("regions").alias("name"), "document")
    known = doc.unionByName(spark.createDataFrame([("status", "ok")], "name string, document string"))
    name = F.when(F.col("doc_id") % 3 == 0, "regions").when(F.col("doc_id") % 3 == 1, "status").otherwise("unknown")
    p = t("documents").select("doc_id", F.concat("text", F.lit(" {{DATA:"), name, F.lit("}}")).alias("prompt"))
    p = p.withColumn("long_", F.length("prompt") > 60)
    return files.injected(p, "prompt", known)


@query("i02_placeholder_detection", "SELECT count(*) AS n FROM documents WHERE regexp_matches(text || CASE WHEN doc_id % 4 = 0 THEN '{{DATA:x}}' ELSE '{{DATA:}}' END, '\\{\\{DATA:[A-Za-z0-9_-]+\\}\\}')")
def _(t):
    text = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "{{DATA:x}}").otherwise("{{DATA:}}"))
    return t("documents").filter(files.has_placeholder(text)).agg(F.count(F.lit(1)).alias("n"))


@query("i03_cache_control", "SELECT doc_id, length(text) > 3500 AS cache_control FROM documents")
def _(t):
    return t("documents").select("doc_id", cache_control(F.col("text")).alias("cache_control"))


@query("s02_append_order", "SELECT (row_number() OVER (ORDER BY part_, k) - 1) AS pos, k FROM (SELECT 0 AS part_, n_nationkey AS k FROM nation UNION ALL SELECT 1, r_regionkey FROM region)")
def _(t):
    a = D.ordered(t("nation").select(F.col("n_nationkey").alias("k")), "k")
    n = a.agg(F.count(F.lit(1)).alias("n"))
    b = D.ordered(t("region").select(F.col("r_regionkey").alias("k")), "k").crossJoin(F.broadcast(n)).withColumn("_ord", F.col("_ord") + F.col("n")).drop("n")
    return a.unionByName(b).select(F.col("_ord").alias("pos"), "k")


@query("s25_generated_flat", None)
def _(t):
    return files.generated(t("region").sparkSession, "flat", 1000)


@query("x08_sha256_row", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("hash"))


# The 256 values of the table come from its rule, eight steps each; a text's bytes are read from its hexadecimal form.
CRC = """
WITH RECURSIVE s AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM s WHERE k < 8),
 z AS (SELECT list(c ORDER BY i) AS tab FROM s WHERE k = 8), h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents)
SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS crc FROM h, z"""


@query("x09_crc32", CRC)
def _(t):
    return t("documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("x11_hash_chain", "SELECT o_orderkey, sha256(sha256(sha256('seed') || 'a' || 'b1' || o_orderstatus) || 'c' || 'b1' || o_orderpriority) AS chain FROM orders")
def _(t):
    stages = F.array(F.struct(F.lit("a").alias("label"), F.col("o_orderstatus").alias("data")), F.struct(F.lit("c").alias("label"), F.col("o_orderpriority").alias("data")))
    return t("orders").select("o_orderkey", S.hash_chain(stages, F.lit("seed"), "b1").alias("chain"))


@query("x12_watermark", "SELECT doc_id, sha256(sha256(text) || octet_length(encode(text))::VARCHAR || 'v1') AS mark FROM documents")
def _(t):
    return t("documents").select("doc_id", S.watermark(F.sha2("text", 256), F.octet_length("text"), "v1").alias("mark"))


@query("x13_fingerprint_similarity", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE
 0.5 * (((o_orderstatus = 'F')::INT + (o_orderpriority = '1-URGENT')::INT)::DOUBLE / 2) + 0.3 + 0.2 * (1 - abs(o_orderkey % 100 - 50)::DOUBLE / 100) END AS similarity FROM orders""")
def _(t):
    a, b = F.array("o_orderstatus", "o_orderpriority"), F.array(F.lit("F"), F.lit("1-URGENT"))
    return t("orders").select("o_orderkey", S.fingerprint_similarity(a, b, F.lit(True), F.col("o_orderkey") % 100, F.lit(50)).alias("similarity"))


@query("x18_token_estimate", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def _(t):
    return t("documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"), S.byte_size(F.col("text")).alias("bytes"))
