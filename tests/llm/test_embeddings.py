import math
from collections import Counter

import numpy as np
import pytest

from granary.llm import embeddings


def brute(rows, threshold=0.98):
    ok = [l is not None and e is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e) and any(e) for _, e, l in rows]
    unit = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if g else None for (_, e, _), g in zip(rows, ok)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    low = {}
    for k, (v, _, _) in enumerate(rows):
        low.setdefault(find(k), []).append((v is not None, v or 0, v))
    return Counter((v, n[k], min(low[find(k)])[2], v is not None and v == min(low[find(k)])[2]) for k, (v, _, _) in enumerate(rows))


def vectors(seed, dims=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(60):
        base = rng.normal(size=dims)
        for _ in range(rng.integers(1, 6)):
            out.append(((base + rng.normal(size=dims) * rng.choice([0, 0.01, 0.05, 0.2])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    centre = rng.normal(size=dims)
    out += [((centre + rng.normal(size=dims) * 0.06).astype(np.float32).tolist(), 7) for _ in range(70)]
    rows = [(k, e, l) for k, (e, l) in enumerate(out)]
    odd = [None, [], [0.0] * dims, [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [1.0, 2.0], [1e30] * dims]
    rows += [(1000 + k, e, l) for k, e in enumerate(odd * 2) for l in [1]] + [(2000, out[0][0], None), (2001, out[0][0], None)]
    return [*rows, rows[3], rows[3], (None, rows[80][1], rows[80][2])]


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 8)])
def test_against_brute_force(spark, seed, block):
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = embeddings.near_copies(df, recall=1 - 1e-7, block=block).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows)
    assert embeddings.near_copies(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows, total = [], 300
    for k in range(total):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (0.9801 * a + math.sqrt(1 - 0.9801**2) * b).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in embeddings.near_copies(df).collect()) / 2
    assert found >= 0.93 * total


def test_chance_of_a_shared_cell():
    rng = np.random.default_rng(3)
    gap, shift = rng.normal(size=200_000) * 0.2, rng.random(200_000) * 1.5
    assert abs((np.floor(shift / 1.5) == np.floor((shift + gap) / 1.5)).mean() - embeddings.cell_chance(1.5, 0.2)) < 0.005


def test_a_large_group(spark):
    """Of a bucket that holds nearly all vectors every link is counted, block by block."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    rows = [(k - 2**63 if k == 0 else k, (centre + rng.normal(size=8) * 0.02).tolist(), 3) for k in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_copies(df, recall=1 - 1e-9, block=64).collect())
    assert got == brute(rows)
