import random
import zlib

import numpy as np

from granary.llm import quality


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        ws = rng.choices(vocab, k=rng.randint(5, 80))
        good = rng.random() < 0.6
        rows.append((k, " ".join(ws) if good else " ".join(w + "###" for w in ws), 0.5))
        labels.append((k, int(good), 0))
    return rows, labels


def test_accuracy_on_the_held_out_fold(spark):
    rows, labels = corpus(800)
    docs = spark.createDataFrame([*rows, (9001, None, 0.0), (9002, "", 0.0), (9003, "word " * 50_000, 0.0), (None, "null id", 0.0), (5, rows[5][1], 0.0)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0), (7, 5, 0), (8, labels[8][1], 0)], "doc_id long, quality int, toxic int")
    vectors, net = quality.fit(docs, lab)
    got = {r.doc_id: r for r in quality.score(docs, vectors, net).collect()}
    assert len(got) == 804
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((got[k].score >= 0.5) == bool(labels[k][1]) for k in held)
    assert right / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(7), *quality.fit(docs.repartition(5), lab.repartition(3))).collect()}
    assert all(again[k] == got[k].score for k in again)
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, *quality.fit(docs, lab)).collect()] == [0.5]
    assert quality.score(docs.limit(0), *quality.fit(docs.limit(0), lab)).count() == 0


def test_context_sums_against_a_loop(spark):
    texts = ["a b c a", "", None, "c", "b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place, sign = quality.index_vectors(quality.SLOTS, quality.DIMS)
    want = np.zeros((quality.SLOTS, quality.DIMS))
    read = quality.slot_reader(quality.SLOTS)
    for t in texts:
        s = read(t)
        for i in range(len(s)):
            for j in range(len(s)):
                if i != j and abs(i - j) <= 2:
                    want[s[i], place[s[j]]] += sign[s[j]]
    assert (quality.context_vectors(docs) == want).all()


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(int)
    net = quality.train(x, y, np.arange(600) % 4 == 0)
    p = net.probability(x)
    assert abs(p.mean() - y.mean()) < 0.05 and net.temperature != 1.0
