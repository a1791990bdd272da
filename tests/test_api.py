import json

import pytest
from pyspark.sql import functions as F

from granary import api
from granary.__main__ import main
from granary.functions import token_stream
from granary.functions.tokens import decode_tokens, encode_text
from granary.operators import pretokenized
from granary.operators.store import ContentStore

ROWS = [{"id": k, "name": f"user {k}", "state": "waiting for review", "score": None if k % 2 else k / 2} for k in range(30)]


def test_stored_dataset(spark, tmp_path):
    store = ContentStore(spark, f"{tmp_path}/s")
    d = api.StoredDataset.encode(spark, store, ROWS)
    body = store.blobs().first()["hash"]
    again = api.StoredDataset.load(spark, store, body)
    assert again.hash == d.hash and json.loads(d.to_json()) == ROWS
    assert d.tokens("gpt-4o", 5) == d.tokens("gpt-4o")[:5] and d.token_count("gpt-4o") == len(d.tokens("gpt-4o"))
    rows = token_stream.decode_rows(token_stream.from_binary(d.token_binary("gpt-4o"))[1], decode_tokens)
    assert [r["name"] for r in rows] == [r["name"] for r in ROWS] and rows[1]["score"] is None
    got = api.compose_from_hashes(store, [body], "be brief", "gpt-4o").orderBy("ord").collect()
    assert [r.included for r in got] == [True, True]
    assert api.cache_warm(store, ["gpt-4o"]) == {"gpt-4o": 1}
    assert {r.model for r in api.cache_diagnose(store).filter("ready").collect()} == {"gpt-4o"}


def test_quick_and_messages(spark):
    q = api.quick(spark, ROWS)
    assert q["tokens"] < q["json_tokens"] and q["text"].startswith("@c\tstate=waiting for review")
    assert [r["model"] for r in api.analyze_savings(spark, ROWS[:3], ["gpt-4o", "no-model"])] == ["gpt-4o"]
    m = [{"role": "system", "content": "x"}, {"role": "user", "content": json.dumps(ROWS)}]
    assert api.compile_last_message(spark, m)[1]["content"] == q["text"]
    assert api.compile_last_message(spark, [{"role": "user", "content": "[not json"}])[0]["content"] == "[not json"
    assert all(api.validate(spark, ROWS).values()) and api.injects_tokens(True) and not api.injects_tokens(False)


def test_token_lines_agree_with_the_codec(spark):
    df = spark.createDataFrame([(0, "a", "x y"), (1, None, "z"), (2, "b", None)], "o int, p string, q string")
    want = token_stream.encode_rows([{"p": "a", "q": "x y"}, {"p": None, "q": "z"}, {"p": "b", "q": None}], encode_text)
    got = [i for r in api.token_lines(df, ["o"]).orderBy("o").collect() for i in r.tokens]
    assert want[want.index(token_stream.ROW) :] == got


def test_prefixes(spark):
    df = spark.range(6).select(F.col("id").alias("o"), F.concat(F.lit("row "), 9 - F.col("id")).alias("name"), (9 - F.col("id")).alias("key"))
    one = api.prefix_reuse(df, ["o"], "name").first()
    assert 0 < one.shared < one.tokens
    sim = {(r.change, r.rendering): (r.shared, r.chars) for r in api.prefix_simulation(df, "o", 6, {"name": F.lit("new"), "key": F.lit(0).cast("long")}, "key").collect()}
    assert sim["append", "stored"][0] == sim["append", "stored"][1] and sim["prepend", "stored"][0] < 6 and len(sim) == 14


def test_profile():
    p = api.Profile()
    with p.stage("one"):
        pass
    assert p.total() >= 0 and set(p.stages) == {"one"}


@pytest.mark.parametrize("verb", ["analyze", "formats", "convert", "query", "savings", "encode", "validate", "budget"])
def test_verbs(spark, tmp_path, capsys, verb):
    (tmp_path / "d.json").write_text(json.dumps(ROWS))
    assert main([verb, f"{tmp_path}/d.json", "--query", "GET data WHERE id < 3 FORMAT csv"]) == 0
    assert capsys.readouterr().out


def test_encoding_stats(spark):
    df = spark.createDataFrame([(k, f"user {k % 3}", None if k % 2 else "waiting") for k in range(12)], "k int, name string, state string")
    got = api.encoding_stats(df, ["k"]).first()
    lines = [r.tokens for r in api.token_lines(df, ["k"]).collect()]
    assert (got.rows, got.total_tokens, got.unique_tokens) == (12, sum(map(len, lines)), len({x for r in lines for x in r}))
    plain = sum(len(encode_text(json.dumps({"name": f"user {k % 3}", "state": None if k % 2 else "waiting"}, separators=(",", ":")))) for k in range(12))
    assert got.json_tokens == plain and got.reduction_pct == round(100 * (1 - got.total_tokens / plain), 1)


def test_verbs_over_the_store(spark, tmp_path, capsys):
    with open(f"{tmp_path}/d.json", "w") as f:
        json.dump(ROWS, f)
    run = lambda verb, file=f"{tmp_path}/d.json", *more: (main([verb, file, "--store", f"{tmp_path}/s", *more]), capsys.readouterr().out.strip())
    code, body = run("ir-encode")
    assert code == 0 and ContentStore(spark, f"{tmp_path}/s").has(body)
    assert body in run("status", "-")[1]
    assert json.loads(run("cache-warm", "-")[1]) == {"gpt-4o": 1}
    assert run("cache-diagnose", "-")[1].endswith("ready")
    assert "gpt-4o" in run("cache-stats", "-")[1]
    shown = json.loads(run("ir-inspect", body)[1])
    assert shown["rows"] == len(ROWS) and json.loads(run("ir-materialize", body)[1])["tokens"] > 100
    assert len(run("compose", body, "--system", "be brief")[1].splitlines()) == 2
    assert json.loads(run("guard")[1])["passed"] and "reduction" in json.loads(run("scorecard")[1])
    code, out = run("inject", f"{tmp_path}/d.json", "--system", "rows: {{DATA:data}} and {{DATA:other}}", "--format", "csv")
    assert "user 3" in out and out.endswith("{{DATA:other}}")
    assert set(json.loads(run("bench")[1])) >= {"csv", "compact"}


def test_pretokenized_blocks(spark, tmp_path):
    rows = [(k, None if k % 7 == 3 else f"name {k % 5}", "" if k == 2 else "waiting for review") for k in range(50)]
    df = spark.createDataFrame(rows, "k int, name string, state string")
    pretokenized.write_block(df, ["k"], f"{tmp_path}/b", group=8)
    got = {(r.field, r.row): r.tokens for r in pretokenized.read_block(spark, f"{tmp_path}/b", group=8).collect()}
    assert got == {(f, k): None if v is None else encode_text(v) for k, a, b in rows for f, v in (("name", a), ("state", b))}
    part = pretokenized.read_block(spark, f"{tmp_path}/b", "name", 5, 9, group=8).collect()
    assert {r.row: r.tokens for r in part} == {k: got["name", k] for k in range(5, 14)}
