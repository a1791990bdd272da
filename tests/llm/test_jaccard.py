import random
import re
from collections import Counter

import numpy as np
import pytest

from granary.llm import components as components_
from granary.llm import jaccard
from granary.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, width=4):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(ws) < width:
        return frozenset([tuple(ws)]) if ws else frozenset()
    return frozenset(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1))


def brute(rows, percent=85, width=4):
    own = [sets_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] and own[j] and 100 * both >= percent * len(own[i] | own[j]):
                root[find(i)] = find(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        low.setdefault(find(k), []).append((d is not None, d or 0, d))
    return Counter((d, len(own[k]), min(low[find(k)])[2]) for k, (d, _) in enumerate(rows))


def corpus(seed, groups=25, most=12):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["É", "Ab"]
    rows, bottom = [None, "", " \t", "One two", "one TWO", "one two three", "a b c d", "A B C D", "a b c d e"], "all rights reserved by the authors of this work and others"
    for _ in range(groups):
        base = rng.choices(vocab, k=int(2 ** rng.uniform(2, 9.5)))
        for _ in range(rng.randint(1, most)):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(ws) // 60])):
                k = rng.randrange(len(ws) + 1)
                ws[k : k + rng.randint(0, 1)] = rng.choices(vocab, k=rng.randint(0, 2))
            if rng.random() < 0.3:
                ws += bottom.split()
            rows.append(" ".join(ws).upper() if rng.random() < 0.2 else " ".join(ws))
    rng.shuffle(rows)
    return [(k if k != 5 else None, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_against_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, component_id int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_documents(docs, width, percent).collect())
    assert got == brute(rows, percent, width)


def test_schemes_meet_every_similar_set():
    rng = np.random.default_rng(1)
    made = {}
    for n in [*range(5, 40), 60, 100, 250, 700]:
        for _ in range(6):
            s = rng.integers(0, 2**63, n).astype(np.uint64)
            bound = 15 * 2 * n // 185
            out = rng.integers(0, bound + 1)
            other = np.concatenate([s[out:], rng.integers(0, 2**63, rng.integers(0, bound - out + 1)).astype(np.uint64)])
            both = n - out
            if 100 * both < 85 * (n + len(other) - both) or not len(other):
                continue
            s1, s2 = np.unique(s), np.unique(other)
            mine = {x.band: x.keys(s1) for x in jaccard.schemes_of(len(s1), 85, made)}
            own = {x.band: x.keys(s2) for x in jaccard.schemes_of(len(s2), 85, made)}
            shared = [(len(np.intersect1d(mine[b][0], own[b][0])), mine[b][1], own[b][1]) for b in mine.keys() & own.keys()]
            # More common keys than either may skip, in one of the schemes.
            assert len(s1) == len(s2) and (s1 == s2).all() or any(c > min(a, b) for c, a, b in shared), (n, len(other), shared)


def test_repeated_and_missing_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(3, text), (3, text), (9, text), (4, None), (4, None), (8, "")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_documents(docs, 4, 85).collect())
    assert got == Counter([(3, 9, 3), (3, 9, 3), (9, 9, 3), (4, 0, 4), (4, 0, 4), (8, 0, 8)])
    assert jaccard.join_documents(docs.limit(0)).count() == 0


def test_one_of_each_group(spark):
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:59], "z"]), "another text of a few words only"
    rows = [(None, text), (None, near), (7, text), (5, near), (5, near), (None, other), (None, other), (2, None), (2, None), (None, ""), (-(2**63), "a b c d e f"), (9, "A b c d e f")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, tag string, doc int")
    got = jaccard.one_of_each(docs)
    assert got.schema == docs.schema
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(5, near), (None, other), (2, None), (None, ""), (-(2**63), "a b c d e f")])


def test_classes_of_one_number(spark, monkeypatch):
    """Unlike sets whose first number is the same are told apart by the second, with another salt."""
    whole = jaccard.class_of
    monkeypatch.setattr(jaccard, "class_of", lambda s, salt=0: (whole(s, salt)[0] if salt else 1, whole(s)[1]))
    rows = [(1, "a b c d e f g"), (2, "t u v w x y z"), (3, "a b c d e f g")]
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("small", [0, 1000])
def test_components_of_paths_and_stars(spark, monkeypatch, small):
    monkeypatch.setattr(components_, "SMALL", small)
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(900, 1000)] + [(5000, 5000), (7001, 7000)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert not components(spark.createDataFrame([], "a long, b long")).collect()
    assert got == {k: 0 for k in range(61)} | {k: 900 for k in range(900, 1001)} | {7000: 7000, 7001: 7000}


def test_sketches_never_exclude_similar_sets(spark):
    """Bits in which sketches differ, folded where their sizes do, are no more than the shingles in which the sets differ."""
    rng = np.random.default_rng(6)
    for n in (385, 500, 513, 1000, 1025, 3000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = np.concatenate([s[n // 9 :], rng.integers(0, 2**63, n // 12).astype(np.uint64)])
        x, y = jaccard.wide_sketch_of(s), jaccard.wide_sketch_of(other)
        if x is None or y is None:
            continue
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert sum(int(a).bit_count() for a in (x ^ y).view(np.uint64)) <= len(np.setxor1d(s, other))


def test_long_texts(spark):
    rng = random.Random(4)
    rows = []
    for g in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(500 + 400 * g)]
        for k in range(4):
            ws = list(base)
            for _ in range(k * len(ws) // 60):
                ws[rng.randrange(len(ws))] = "z"
            rows.append((len(rows), " ".join(ws + ["the", "end"] * 40)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 80, 5)
