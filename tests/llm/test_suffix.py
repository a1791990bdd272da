import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import suffix


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[k : k + length] for x in raw for k in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("reach", [1, 2, 3, 7, 30])
def test_ranks_order_suffixes(reach):
    rng = np.random.default_rng(reach)
    for n in (1, 2, 3, 4, 5, 50, 400):
        for kinds in (1, 2, 5):
            t = rng.integers(1, kinds + 1, n)
            rank = suffix.suffix_ranks(t, reach)
            heads = [tuple(t[k : k + reach]) for k in np.argsort(rank, kind="stable")]
            assert heads == sorted(heads), (n, kinds)


def test_repeated_windows():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 4):
        t = rng.integers(0, kinds, 300).astype(np.uint8)
        at = np.flatnonzero(rng.random(290) < 0.8)
        seen = Counter(t[k : k + 9].tobytes() for k in at)
        assert suffix.repeated_windows(t, at, 9).tolist() == [seen[t[k : k + 9].tobytes()] > 1 for k in at]


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    long = lambda n: " ".join(word() for _ in range(n))
    shared = [long(rng.randint(3, 60)) for _ in range(6)]
    out = [None, "", "a", "ab" * 300, "x" * 500, long(3000)]
    for _ in range(60):
        parts = [long(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            if rng.random() < 0.3:
                k = rng.randrange(len(s))
                s = s[:k] + "Z" + s[k + 1 :]
            parts += [s, long(rng.randint(0, 20))]
        out.append(" ".join(parts))
    return out + out[10:20]


@pytest.mark.parametrize(("seed", "length", "gram", "crowd"), [(1, 40, 8, 4096), (2, 40, 8, 2), (3, 200, 32, 4096), (4, 25, 5, 1)])
def test_against_brute_force(spark, seed, length, gram, crowd):
    t = texts(seed)
    docs = spark.createDataFrame([(k if k % 7 else None, x, k, 0) for k, x in enumerate(t)], "doc_id long, text string, tag int, n_bytes int")
    got = suffix.remove_repeats(docs, length, gram, crowd)
    want = Counter((k if k % 7 else None, *r) for k, r in enumerate(brute(t, length)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_no_rows(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_tag(spark, monkeypatch):
    whole = suffix.with_key
    monkeypatch.setattr(suffix, "with_key", lambda docs, *c: whole(docs, *c).withColumn("tag", F.lit(1).cast("long")))
    rng = random.Random(3)
    a, b, c = ("".join(rng.choices("abcdefgh", k=n)) for n in (900, 400, 250))
    rows = [(None, a), (None, b), (None, c + a[300:700]), (7, "ab" * 500)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(brute([t for _, t in rows], 200))
