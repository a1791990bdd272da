import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import DecodingError, ValidationError
from granary.functions import canonical, record_text, token_stream
from granary.functions import scalar as S

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


@pytest.mark.parametrize(
    ("value", "hexa"),
    [
        (None, "54454e53020000"),
        (True, "54454e53020001"),
        (42, "54454e530200032a"),
        (-1, "54454e53020003ff"),
        (1000, "54454e53020005e8030000"),
        (0, "54454e5302000300"),
        ([], "54454e5302000800"),
        ({}, "54454e5302000900"),
        ("hello", "54454e53020105" + b"hello".hex() + "0700"),
        ({"a": "x", "b": 1}, "54454e5302030161017801620902000701020301"),
        ({"b": 1, "a": "x"}, "54454e5302030161017801620902000701020301"),
    ],
)
def test_canonical_vectors(value, hexa):
    assert canonical.encode(value).hex() == hexa
    assert canonical.content_hash(value) == hashlib.sha256(bytes.fromhex(hexa)).hexdigest()


def test_canonical_rules():
    assert canonical.canonical({"b": "ﬁ x  \ny\t", "a": [float("nan"), -0.0, float("inf")]}) == {"a": [None, 0.0, None], "b": "fi x\ny"}
    assert canonical.decode(canonical.encode(2**31)) == float(2**31)
    assert canonical.encode({"x": 1.0}) == canonical.encode({"x": 1})


@settings(max_examples=150, deadline=None)
@given(JSON)
def test_canonical_round_trip(value):
    assert canonical.decode(canonical.encode(value)) == canonical.canonical(value)


def test_damaged_blobs_are_refused():
    blob = canonical.encode({"a": [1, "text", 2.5]})
    for bad in (b"", blob[:-1], b"XXXX\x02" + blob[5:], blob + b"\0"):
        with pytest.raises(DecodingError):
            canonical.decode(bad)


def test_validation():
    loop = []
    loop.append(loop)
    for bad in (loop, {"__proto__": 1}, {1: 2}, object(), json.loads("[" * 60 + "]" * 60)):
        with pytest.raises(ValidationError):
            canonical.validate(bad)
    canonical.validate({"a": [1, 2.5, None, True, "x"]})


ROWS = st.lists(st.fixed_dictionaries({"id": st.integers(1, 10**5), "name": st.text(), "score": st.none() | st.integers(0, 100), "active": st.booleans(), "tag": st.lists(st.text(), max_size=4)}), min_size=1, max_size=20)


@settings(max_examples=150, deadline=None)
@given(ROWS)
def test_record_text_round_trip(rows):
    assert record_text.decode(record_text.encode(rows)) == rows


def test_record_text_details():
    rows = [{"s": v} for v in ["", " ", "@0", "#1", "true", "_", "42", "-3.14", '"\\|', "日本", "a b"]]
    assert record_text.decode(record_text.encode(rows)) == rows
    assert record_text.encode([]) == "@version 1\n@encoding o200k_base\n@schema data"
    text = record_text.encode([{"v": "long value"}] * 3)
    assert '@dict "long value"' in text and text.count("@0") == 3
    assert record_text.decode("@schema data a:str? b:num[]\n@future x\n\ndata\n  a @9\n") == [{"a": None, "b": []}]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": st.text(max_size=8), "b": st.none() | st.booleans(), "c": st.lists(st.text(min_size=1, max_size=4), max_size=3)}), min_size=1, max_size=8))
def test_token_stream_round_trip(rows):
    encode, decode = lambda s: list(s.encode()), lambda ids: bytes(ids).decode()
    name, ids = token_stream.from_binary(token_stream.to_binary(token_stream.encode_rows(rows, encode), "bytes"))
    assert name == "bytes" and token_stream.decode_rows(ids, decode) == rows


def test_token_stream_shapes_and_damage():
    encode, decode = lambda s: list(s.encode()), lambda ids: bytes(ids).decode()
    wide = [{f"f{k}": str(k) for k in range(201)}, {"x": "1"}]
    assert token_stream.decode_rows(token_stream.encode_rows(wide, encode), decode) == [dict(sorted(r.items())) for r in wide]
    blob = token_stream.to_binary([1, 2], "e")
    for bad in (b"", blob[:-1], b"?" + blob[1:]):
        with pytest.raises(DecodingError):
            token_stream.from_binary(bad)


def test_numbers_as_text_and_back(spark):
    xs = [5.0, 1e7, 1e-5, -0.0, 0.1, 1.5e-7, 1e21, 1e22, 123456789.125, -2.5e10, float("nan"), float("inf")]
    want = ["5", "10000000", "0.00001", "0", "0.1", "1.5e-7", "1e+21", "1e+22", "123456789.125", "-25000000000", "NaN", "Infinity"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").orderBy("k").select(S.to_text(F.col("x"), T.DoubleType()).alias("s")).collect()
    assert [r.s for r in got] == want
    texts = ["", " 12 ", "abc", "0x10", "1e3", ".5", "5d", "Infinity"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k").select(S.to_number(F.col("x")).alias("n")).collect()
    assert [r.n for r in got] == [0.0, 12.0, None, 16.0, 1000.0, 0.5, None, None]


def test_arrays(spark):
    df = spark.createDataFrame([([100, 101, 103],), ([],), ([5],)], "a array<int>")
    assert [r.d for r in df.select(S.delta_encode(F.col("a")).alias("d")).collect()] == [[100, 1, 2], [], [5]]
    rle = spark.createDataFrame([(["a", "a", "b"],), ([],)], "a array<string>").select(S.run_lengths(F.col("a"), "string").alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in rle] == [[("a", 2), ("b", 1)], []]
    p = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([1], [1, 2]), ([], [1]), ([2], [1]), (None, [1])], "a array<int>, b array<int>")
    assert [r.n for r in p.select(S.prefix_length(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 1, 0, 0, 0]
    c = spark.createDataFrame([("abcd", "abxd"), ("", "a"), ("same", "same"), ("x" * 3000, "x" * 2999 + "y")], "a string, b string")
    assert [len(r.p) for r in c.select(S.common_prefix(F.col("a"), F.col("b")).alias("p")).collect()] == [2, 0, 4, 2999]
