import re
from collections import Counter, defaultdict

import pytest

from granary.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level(sizes, weights=(3, 1, 2), budget=1.5, ceiling=2.0):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = budget * sum(sizes.values()) - sum(target[s] for s in full)
        open_ = [s for s in names if s not in full]
        for s in open_:
            target[s] = left * w[s] / sum(w[x] for x in open_)
        over = [s for s in open_ if target[s] > ceiling * sizes[s] + 1e-9]
        if not over:
            return target
        for s in over:
            target[s] = ceiling * sizes[s]
            full.add(s)


def test_targets_and_taken_words(spark):
    rows = [(k, "w " * (k % 37), f"s{k % 7}" if k % 7 else None, 0) for k in range(900)] + [(k, "x y", "tiny", 0) for k in range(900, 903)]
    rows += [(2000, None, "s1", 0), (2001, "", "s1", 0), (2002, " \t", "empty", 0), (None, "a b c", "s2", 0), (5, rows[5][1], rows[5][2], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = level(sizes)
    source = {d: s for d, _, s, _ in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 37, s
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_equal_rows_and_rows_without_ids(spark):
    """Neither equal rows nor different texts without a doc_id are taken or left together."""
    docs = [(1, "a b c d e f", "s1")] * 800 + [(None, f"t{k} x y z u v", "s2") for k in range(800)] + [(k, "w " * 6, "s3") for k in range(800)]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, source string, j int")
    got = mixing.mix(df).collect()
    assert len(got) == len(docs)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.target, r.doc_id is None] += r.taken
        target[r.target, r.doc_id is None] = r.target
        assert 0 < r.inclusion < 1 or r.target == 2 * r.source_size
    # Three sources of 4,800 words and weights 3, 1, 2: two of them with a target of their own.
    assert sum(r.taken for r in got) == pytest.approx(sum(level({"s1": 4800, "s2": 4800, "s3": 4800}).values()), abs=18)
    for k, t in target.items():
        assert abs(taken[k] - t) <= 6, k
    out = mixing.mixed(df)
    assert out.schema == df.schema
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in got for _ in range(r.copies))


def test_rows_that_give_very_many(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 10)
    df = spark.createDataFrame([(1, "a b", "s")] * 95 + [(2, "c", "s")] * 3, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert Counter(r.doc_id for r in got) == Counter({1: 95, 2: 3})
    assert Counter(r.doc_id for r in mixing.mixed(df).collect()) == Counter(r.doc_id for r in got for _ in range(r.copies))


def test_inclusion_odds_meet_the_target(spark):
    rows = [(k, "w " * (1 + k * k % 211), f"s{k % 3}") for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(float)
    for r in got:
        by[r.target, r.source_size] += r.size * (r.inclusion + r.target // r.source_size)
    for (target, _), words in by.items():
        assert words == pytest.approx(target, rel=1e-6)
