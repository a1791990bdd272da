import math

import pytest
from pyspark.sql import functions as F

from granary.engine import Engine
from granary.errors import BudgetExceededError, NotStoredError, QueryError, UnknownFormatError, UnknownModelError
from granary.functions import scalar as S
from granary.operators import budget as B
from granary.operators import dataset as D
from granary.operators import guard, render, session, stats, store
from granary.plans import models
from granary.plans.miniquery import MiniQuery, filter_text, parse, predicate
from granary.sources import files


def test_parse():
    assert parse("get t where a > 5 limit 10 format CSV") == MiniQuery("t", ("a", ">", "5"), 10, "csv")
    assert parse("GET t noise WHERE a = 1 WHERE b = 2 LIMIT x") == MiniQuery("t", ("b", "=", "2"), None, None)
    assert parse("GET t WHERE a =") == MiniQuery("t")
    for bad in ("", "SELECT 1", "GET"):
        with pytest.raises(QueryError):
            parse(bad)


@pytest.mark.parametrize("op", ["=", "!=", ">", "<", ">=", "<="])
@pytest.mark.parametrize("value", ["0", "5", "-3", "2.5", "abc", "05"])
def test_typed_predicates_agree_with_text(spark, op, value):
    rows = [(0, 0.0), (5, 5.0), (-3, -3.0), (7, 2.5), (None, None), (2, float("nan"))]
    df = spark.createDataFrame(rows, "i int, d double")

    def plain(v):
        text = "" if v is None else "NaN" if v != v else str(int(v)) if float(v).is_integer() else repr(v)
        if op in ("=", "!="):
            return (text == value) == (op == "=")
        try:
            a, b = 0.0 if text == "" else float(text), float(value)
        except ValueError:
            return False
        return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]

    for c in ("i", "d"):
        want = sum(plain(r[0 if c == "i" else 1]) for r in rows)
        assert df.filter(predicate(df, c, op, value)).count() == want, (c, op, value)


def test_typed_predicates_reach_the_scan(spark, tmp_path, capsys):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    filter_text(spark.read.parquet(f"{tmp_path}/t"), "id > 5").explain("formatted")
    assert "GreaterThan(id,5)" in capsys.readouterr().out


def people(spark):
    return spark.createDataFrame([(1, "Ann, B", None, True), (2, 'say "hi"', 2.0, False), (3, "x|y\nz", 2.5, None)], "id int, name string, score double, active boolean")


def test_rendering(spark):
    df = people(spark).withColumn("_o", F.col("id"))
    out = lambda f: render.document(render.lines(df, f, ["_o"]), ["_o"]).first()["document"]
    assert out("csv") == 'id,name,score,active\n1,"Ann, B",,true\n2,"say ""hi""",2,false\n3,"x|y\nz",2.5,'
    assert out("markdown") == '| id | name | score | active |\n| --- | --- | --- | --- |\n| 1 | Ann, B |  | true |\n| 2 | say "hi" | 2 | false |\n| 3 | x\\|y z | 2.5 |  |'
    assert out("tsv").split("\n")[1] == "1\tAnn, B\t\ttrue"
    assert out("json_min").split("\n")[0] == '{"id":1,"name":"Ann, B","score":null,"active":true}'
    assert out("compact") == 'id\tname\tscore\tactive\n1\tAnn, B\t_\tT\n2\tsay "hi"\t2\tF\n3\tx|y\\nz\t2.5\t_'
    with pytest.raises(UnknownFormatError):
        render.lines(df, "nope", ["_o"])


def test_compact_decisions(spark):
    rows = [(k, "fixed", f"https://example.com/item/{k}", f"https://example.com/item/{k}/comments", "waiting for review" if k % 2 else "done already", None if k else "x") for k in range(40)]
    df = spark.createDataFrame(rows, "_o int, kind string, url string, comments_url string, state string, rare string")
    p = render.compact_plan(df, ["_o"])[1]
    assert p.constants == {"kind": "fixed"} and p.templates == {"comments_url": ("url", "", "/comments")}
    assert p.active == ["url", "state", "rare"] and p.prefixes == {0: "https://example.com/item/"} and not p.sparse
    assert p.dictionary == ["waiting for review", "done already"]
    lines = [r.line for r in render.lines(df, "compact", ["_o"]).orderBy("part", "_o").collect()]
    assert lines[0] == "@c\tkind=fixed" and lines[-1] == "39\t@0\t_"
    one = render.document(render.lines(df.limit(1), "compact", ["_o"]), ["_o"]).first()["document"].split("\n")
    assert one[0].startswith("@c\t") and one[1:] == ["", ""]
    assert render.lines(df.limit(0), "compact", ["_o"]).count() == 0


def test_record_text_agrees_with_the_codec(spark):
    from granary.functions import record_text

    df = people(spark).withColumn("tags", F.array(F.lit("a b"), F.lit("c"))).withColumn("_o", F.col("id"))
    text = render.document(render.lines(df, "record_text", ["_o"]), ["_o"]).first()["document"]
    rows = [{"id": 1, "name": "Ann, B", "score": None, "active": True, "tags": ["a b", "c"]}, {"id": 2, "name": 'say "hi"', "score": 2, "active": False, "tags": ["a b", "c"]}, {"id": 3, "name": "x|y\nz", "score": 2.5, "active": None, "tags": ["a b", "c"]}]
    assert record_text.decode(text) == rows


@pytest.mark.parametrize("n", [1, 7])
def test_order_does_not_depend_on_partitions(spark, n):
    df = spark.range(500).withColumn("k", F.xxhash64("id")).repartition(n)
    got = [r["_ord"] for r in D.ordered(df, "k").orderBy("k").collect()]
    assert got == list(range(500))


def test_short_names():
    assert D.short_names(["created", "creator", "id", "id_hash"]) == {"created": "create", "creator": "creato", "id": "id", "id_hash": "id_"}
    short = D.short_names(["alpha", "beta", "alphabet"])
    assert len(set(short.values())) == 3 and short["beta"] == "b"


def test_flatten_and_back(spark):
    df = spark.createDataFrame([(1, ("x", (2,)), [1])], "id int, a struct<b:string,c:struct<d:int>>, e array<int>")
    flat = D.flatten(df)
    assert flat.columns == ["id", "a.b", "a.c.d", "e"]
    assert D.unflatten(flat).first() == df.first()


def test_knapsack_is_optimal(spark):
    import itertools
    import random

    rng = random.Random(3)
    items = [(g, k, rng.randint(1, 60), round(rng.random(), 3)) for g in range(4) for k in range(9)]
    df = spark.createDataFrame(items, "g int, id int, tokens long, score double")
    got = B.packed(df, 100, ["g"], "knapsack").filter("selected").groupBy("g").agg(F.sum("tokens").alias("t"), F.sum("score").alias("s")).collect()
    for r in got:
        own = [x for x in items if x[0] == r.g]
        best = max(sum(x[3] for x in c) for k in range(10) for c in itertools.combinations(own, k) if sum(x[2] for x in c) <= 100)
        assert r.t <= 100 and abs(r.s - best) < 0.01


def test_compose_errors(spark):
    blocks = spark.createDataFrame([(0, 0, "sys", True, 10**7, 0)], "p int, ord int, name string, required boolean, tokens long, max_tokens long")
    with pytest.raises(BudgetExceededError):
        B.compose(blocks, "gpt-4o", ["p"])
    with pytest.raises(UnknownModelError):
        B.compose(blocks, "no-model", ["p"])
    models.register_model("no-model", "x", "o200k_base", 10**9, 0.0, 0.0)
    assert B.compose(blocks, "no-model", ["p"]).first()["included"]
    models.reset_models()
    assert "no-model" not in models.MODELS


def test_rows_within_agree(spark):
    df = spark.range(3000).withColumn("t", F.pmod(F.xxhash64("id"), F.lit(40)))
    for budget in (0, 10, 500, 20_000, 10**9):
        a = B.rows_within(df, ["id"], F.col("t"), budget).first()
        b = B.rows_within_large(df, "id", F.col("t"), budget, 16).first()
        assert (a.rows if a else 0) == b.rows and (not a or a.tokens == b.tokens)


def test_store(spark, tmp_path):
    s = store.ContentStore(spark, f"{tmp_path}/store")
    bodies = spark.createDataFrame([("alpha beta", 1), ("gamma", 2), ("gamma", 2)], "body string, rows long")
    assert sorted(r.is_new for r in s.put(bodies).collect()) == [True, True]
    assert [r.is_new for r in s.put(bodies.limit(1)).collect()] == [False]
    h = s.blobs().filter("body = 'gamma'").first().hash
    assert s.has(h) and s.get(h).first().rows == 2 and s.blobs().count() == 2
    with pytest.raises(NotStoredError):
        s.get("0" * 64)
    assert s.peek("gpt-4o").filter("token_count is null").count() == 2
    first = s.materialize("gpt-4o").orderBy("hash").collect()
    assert len(first) == 2 and first == s.materialize("gpt-4o").orderBy("hash").collect()
    assert [r.models for r in s.listing().collect()] == [["gpt-4o"], ["gpt-4o"]]


def test_hash_tree_ignores_partitions(spark):
    df = spark.range(10_000).select("id", F.col("id").cast("string").alias("t"))
    one = store.row_hash_tree(df, "t", ["id"], 8).first()
    assert one == store.row_hash_tree(df.repartition(9), "t", ["id"], 8).first()
    assert one != store.row_hash_tree(df.withColumn("t", F.concat("t", F.lit("x"))), "t", ["id"], 8).first()


def test_session_state(spark, tmp_path):
    s = session.SessionState(spark).observe(spark.createDataFrame([("a",), ("b",), ("",)], "value string"), "id,name")
    s = s.observe(spark.createDataFrame([("b",)], "value string"), "id,name")
    s.save(f"{tmp_path}/state")
    back = session.SessionState.load(spark, f"{tmp_path}/state")
    assert {r.value: r.occurrences for r in back.texts.collect()} == {"a": 1, "b": 2}
    assert back.schemas.first().occurrences == 2


def test_engine(spark):
    e = Engine(spark)
    e.register("people", people(spark), ["id"])
    assert e.query("GET people WHERE score >= 2 FORMAT csv").output() .split("\n")[0] == "name,score,active"
    assert e.query("GET people LIMIT 1").count() == 1 and '"name": "Ann, B"' in e.query("GET people LIMIT 1").output()
    assert e.query("GET nothing").count() == 0 and e.names() == ["people"]
    assert e.context("people", "id > 1").count() == 2
    assert {r.format: r.rows for r in e.budget("people", "gpt-4o").collect()}["csv"] == 3
    assert e.savings("people").count() > 30
    assert e.drop("people") and not e.drop("people")


def test_sources(spark, tmp_path):
    df = D.ordered(people(spark), "id")
    files.append(df, f"{tmp_path}/d")
    files.append(df, f"{tmp_path}/d")
    assert sorted(r["_ord"] for r in files.read_dataset(spark, f"{tmp_path}/d").collect()) == list(range(6))
    assert files.read_dataset(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2, "b": "x"}]')
    assert [r.a for r in files.read_json_array(spark, f"{tmp_path}/a.json").orderBy("_ord").collect()] == [1, 2]
    files.export(people(spark).withColumn("_o", F.col("id")), ["_o"], f"{tmp_path}/out", ("csv", "tsv"))
    assert spark.read.text(f"{tmp_path}/out/tsv").count() == 5
    for fmt in ("json", "yaml", "xml", "csv", "markdown", "tsv", "record_text", "compact"):
        assert files.transcoded(people(spark).withColumn("_o", F.col("id")), fmt, ["_o"]).count() >= 3
    runs = spark.createDataFrame([("2024-01-01", "analyze", "f", "m", {"x": "1"}), ("2024-01-02", "analyze", "f", "m", {"x": "2"})], "ts string, command string, input string, model string, metrics map<string,string>")
    assert files.previous_run(spark, f"{tmp_path}/runs", "analyze", "f", "m") is None
    files.snapshot(runs, f"{tmp_path}/runs")
    assert files.previous_run(spark, f"{tmp_path}/runs", "analyze", "f", "m").metrics == {"x": "2"}


@pytest.mark.parametrize("family", files.FAMILIES)
def test_generated_families(spark, family):
    a = files.generated(spark, family, 30)
    assert a.count() == 30 and a.exceptAll(files.generated(spark, family, 30).repartition(3)).count() == 0


def test_streams(spark, tmp_path):
    from granary.streaming import sessions

    rows = [(k % 7, f"2024-01-01 0{k % 3}:00:00", "get", k % 2 == 0) for k in range(20)]
    df = spark.createDataFrame(rows, "key int, ts string, operation string, hit boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    for name, out in (("seen", sessions.unseen_keys(sessions.parquet_stream(spark, f"{tmp_path}/in", df.schema), "key", "ts")), ("tele", sessions.telemetry(sessions.parquet_stream(spark, f"{tmp_path}/in", df.schema)))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append" if name == "seen" else "complete").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("seen").count() == 7
    assert spark.table("tele").agg(F.sum("total"), F.sum("hits")).first()[:] == (20, 10)


def test_rows_are_matched_one_to_one(spark):
    """Equal leaves first, then the nearest row of the same anchor, each partner once."""
    wide = lambda **x: {"id": 1, **{f"c{j:02d}": f"v{j}" for j in range(24)}, **x}
    a = [wide(), wide(), wide(c01="x"), wide(id=2), {**wide(), "id": None}, {**wide(c03="q"), "id": None}]
    b = [wide(), wide(c02="y"), wide(c01="x", c05="z"), wide(id=2, c01="p", c02="q"), {**wide(), "id": None}, {**wide(c04="q"), "id": None}]
    schema = "id int, " + ", ".join(f"c{j:02d} string" for j in range(24))
    one, two = (spark.createDataFrame([tuple(r.values()) for r in rows], schema) for rows in (a, b))
    # Rows of id 1: one equal pair, two near ones; id 2 differs in two leaves of 25; without an anchor only equal rows match.
    assert guard.matched_rows(one, two).first().asDict() == {"rows": 6, "decoded_rows": 6, "matched": 4}
    g = guard.semantic_guard(one, two).first()
    assert (g.path_pct, g.passed, g.reason) == (100.0, False, "rows")
    assert guard.semantic_guard(one, one).first().passed and not guard.semantic_guard(one, one, F.lit(False)).first().passed
    assert guard.semantic_guard(one, one.limit(5)).first().reason == "row count"
    assert guard.semantic_guard(one.limit(0), one.limit(0)).first().passed


def test_no_filter_on_hashes_below_derived_columns(spark):
    """Below columns that are expressions themselves Spark lists a filter on their hash in 2 to the number of columns forms."""
    one = spark.range(40).select("id", *[F.concat(F.lit(f"v{k}-"), F.col("id").cast("string")).alias(f"c{k}") for k in range(4)])
    joined = guard.told(one).join(guard.told(one).select("leaves").distinct().hint("merge"), "leaves")
    assert "isnotnull(unhex" not in joined._jdf.queryExecution().optimizedPlan().toString() and joined.count() == 40


def test_guard_of_many_derived_columns(spark):
    wide = lambda df: df.select("id", *[F.concat(F.lit(f"v{k}-"), F.col("id").cast("string")).alias(f"c{k}") for k in range(30)])
    one = wide(spark.range(40))
    two = one.withColumns({"c3": F.when(F.col("id") % 4 == 0, "other").otherwise(F.col("c3")), "c5": F.when(F.col("id") % 8 == 0, "other").otherwise(F.col("c5"))})
    assert guard.matched_rows(one, two).first().asDict() == {"rows": 40, "decoded_rows": 40, "matched": 35}


def test_common_prefixes_of_any_length(spark):
    rows = [("x" * n + a, "x" * n + b) for n, a, b in ((0, "", ""), (0, "a", "b"), (5000, "a", "b"), (9000, "", "zz"), (4095, "q", "q"), (70_001, "ü1", "ü2"))]
    got = spark.createDataFrame(rows, "a string, b string").select(F.length(S.common_prefix(F.col("a"), F.col("b"))).alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 5000, 9000, 4096, 70_002]


def test_complexity_counts_paths_and_arrays(spark):
    """Entropy over the paths that are there, arrays at every depth."""
    rows = [((1, "a"), [[1, 2], [3]], [([5, 6],), (None,)]), (None, [[]], None), ((None, "b"), None, [([7],)])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, s struct<x:int,y:string>, n array<array<int>>, o array<struct<z:array<int>>>")
    got = stats.complexity(df, ["id"]).first()
    # Paths: s.x and s.y twice, s itself once, n and o three times each.
    counts = [2, 2, 1, 3, 3]
    assert got.entropy == pytest.approx(-sum(c / 11 * math.log2(c / 11) for c in counts), abs=1e-6)
    # Depth and length of every array that is there.
    arrays = [(1, 2), (2, 2), (2, 1), (1, 2), (2, 2), (1, 1), (2, 0), (1, 1), (2, 1)]
    mean = lambda k: sum(a[k] for a in arrays) / len(arrays)
    assert got.array_complexity == pytest.approx(mean(0) * mean(1), abs=1e-6)
