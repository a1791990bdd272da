import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.llm import phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """rows: (doc_id, text), doc_ids unique; null first."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first, out = {}, []
    for i in sorted(words, key=lambda x: (x is not None, x)):
        ws = words[i]
        gone = [False] * len(ws)
        for k in range(len(ws) - length + 1):
            w = tuple(ws[k : k + length])
            if w in first:
                gone[k : k + length] = [True] * length
            else:
                first[w] = (i, k)
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def texts(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(40)]
    long = lambda n: rng.choice(["", " ", "\n"]) + "".join(rng.choice(vocab) + rng.choice([" ", " ", "\t", "\r\n", "  ", " "]) for _ in range(n))
    shared = [long(rng.randint(10, 120)) for _ in range(6)]
    out = [None, "", "a", "ab " * 300, " \t ", long(4000)]
    for _ in range(60):
        parts = [long(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared).split(" ")
            if rng.random() < 0.4:
                s[rng.randrange(len(s))] = "Z"
            parts += [" ".join(s), long(rng.randint(0, 20))]
        out.append(" ".join(parts))
    out += out[10:20]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "length", "gram", "crowd"), [(1, 20, 6, 4096), (2, 20, 6, 1), (3, 8, 3, 4096), (4, 8, 2, 3)])
def test_against_brute_force(spark, seed, length, gram, crowd):
    rows = [(k if k else None, t) for k, t in enumerate(texts(seed))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, kept string")
    got = phrases.remove_passages(docs, length, gram, crowd).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, length)


def test_repeated_rows_and_equal_ids(spark):
    a, b = " ".join(f"w{k}" for k in range(30)), " ".join(f"w{k}" for k in range(5, 40))
    docs = spark.createDataFrame([(1, a), (1, a), (2, a), (None, None), (3, b), (3, "short")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in phrases.remove_passages(docs).collect())
    assert got == Counter([(1, 30, 0, a), (1, 30, 0, a), (2, 30, 30, ""), (None, 0, 0, ""), (3, 35, 25, " ".join(f"w{k}" for k in range(30, 40))), (3, 1, 0, "short")])
    assert phrases.remove_passages(docs.limit(0)).count() == 0


def test_portions_of_automata(monkeypatch):
    monkeypatch.setattr(phrases, "PHRASES", 3)
    text = " ".join(f"w{k}" for k in range(40))
    got = phrases.located([(2, 5, 0, 38, text), (1, 5, 0, 38, text), (1, 5, 50 << 32, 38, text), (1, 6, 0, 38, text)], 3)
    assert [f.all() for f in got] == [True, False, True, True] and not got[1].any()


def test_rows_without_ids(spark):
    """Thousands of rows without a doc_id are told apart by their texts."""
    rng = random.Random(9)
    shared = [" ".join(f"s{rng.randrange(500)}" for _ in range(25)) for _ in range(20)]
    texts = {f"{k} " + " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(0, 30))) + (" " + rng.choice(shared) if rng.random() < 0.3 else "") for k in range(10_000)}
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = phrases.remove_passages(docs).collect()
    # Hashes of the texts order the rows.
    order = sorted((r.tag, r.text) for r in phrases.with_key(docs).select("tag", "text").collect())
    want = brute([(k, t) for k, (_, t) in enumerate(order)], 20)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((None, *r[1:]) for r in want.elements())
    assert sum(r.n_removed > 0 for r in got) > 2000


def test_rows_of_one_tag(spark, monkeypatch):
    whole = phrases.with_key
    monkeypatch.setattr(phrases, "with_key", lambda docs, *c: whole(docs, *c).withColumn("tag", F.lit(1).cast("long")))
    long = " ".join(f"x{k}" for k in range(200))
    docs = spark.createDataFrame([(1, long), (1, " ".join(f"y{k}" for k in range(90))), (2, " ".join(f"x{k}" for k in range(60, 90)))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in phrases.remove_passages(docs).collect()) == [(1, 90, 0), (1, 200, 0), (2, 30, 30)]


def test_what_repeats_inside_a_text(spark):
    rows = [(1, "a b " * 400), (2, "a b " * 30 + " ".join(f"w{k}" for k in range(30))), (3, ("p q r s t u v w x y " * 9 + "z ") * 5), (4, "p q r s t u v w x y " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrases.remove_passages(docs).collect()) == brute(rows, 20)


def test_lines_stay(spark):
    passage = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(1, passage, "k"), (2, f"one two\n\nthree {passage}\nfour  five\n", "k"), (3, None, None)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in phrases.with_passages_removed(docs, docs.columns).collect()}
    assert got[2].rest == "one two\n\nthree four  five\n" and got[1].rest is None and got[2].carried_2 == "k" and got[3].carried_1 is None
