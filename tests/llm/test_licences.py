import random
import re

from granary.llm import licences

RULE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    ws = RULE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        found = [k for k in range(len(ws)) if ws[k : k + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_columns_against_brute_force(spark):
    rng = random.Random(2)
    bits = ["cc by", "CC-BY", "cc", "by", "general public license", "General Public\nLicense", "all rights reserved", "All Rights", "é", "x1", "!!", "İ", "İcc by", "ccby", "\x7f", "reserved", "public license"]
    rows = [(k, " ".join(rng.choices(bits, k=rng.randint(0, 12))), 1) for k in range(300)] + [(900, None, 1), (901, "", 1), (902, "cc " * 5000 + "by", 1), (3, "cc by", 1), (None, "cc by", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = licences.scan(docs).collect()
    assert len(got) == len(rows)
    texts = {i: {t for j, t, _ in rows if j == i} for i, _, _ in rows}
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in {brute(t) for t in texts[r.doc_id]}
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licences.scan(docs.limit(0)).count() == 0


def test_templates_are_found_where_they_stand():
    index = licences.Index({b"the": 900, b"license": 20, b"licensed": 15, b"under": 300}, 1000)
    for label, text, _ in licences.TEMPLATES:
        ws = licences.words("some words before: " + text.upper() + " and after")
        assert (label, 3, 1.0) in index.scan(ws)


def test_key_phrases_are_mandatory():
    index = licences.Index({}, 10)
    assert not index.scan(licences.words("licensed under the license of apache version 9 9"))
    assert not index.scan(licences.words("mozilla said public things and a license"))
    assert not index.scan([])
    near = index.scan(licences.words("Licensed under the well known Apache License, Version 2.0."))
    assert [m[0] for m in near] == ["apache-2.0"] and near[0][2] < 1


def all_matches(ws, index):
    """Every template at every place, without an index: places where a match scores best among its neighbours."""
    found = []
    for k, (label, template, phrases, votes) in enumerate(index.templates):
        keys = {w: [j for j, x in enumerate(template) if x == w] for w in index.postings if any(p[0] == k for p in index.postings[w])}
        last = None
        for begin in range(-len(template), len(ws)):
            around = lambda j: ws[max(0, begin + j - index.slack) : max(0, begin + j + index.slack + 1)]  # noqa: B023, E731
            n = sum(any(w in around(j) for j in js) for w, js in keys.items())
            if n < votes or not all(any(ws[a : a + len(p)] == p for j in own for a in range(max(0, begin + j - index.slack), begin + j + index.slack + 1)) for own, p in phrases):
                continue
            share = sum(0 <= begin + j < len(ws) and ws[begin + j] == w for j, w in enumerate(template)) / len(template)
            if last is not None and begin - found[last][1] <= 2 * index.slack:
                if share > found[last][2]:
                    found[last] = (k, begin, share)
                continue
            last = len(found)
            found.append((k, begin, share))
    return [(index.templates[k][0], begin, share) for k, begin, share in sorted(found)]


def test_matches_against_brute_force():
    rng = random.Random(8)
    index = licences.Index({}, 10, stretch=37)
    for _ in range(60):
        ws = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice(licences.TEMPLATES)[1].encode().split()
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randint(0, 1)] = [b"odd"] * rng.randint(0, 1)
            ws += t + rng.choices([b"the", b"license", b"software", b"word"], k=rng.randint(0, 30))
        got = licences.Index({}, 10).scan(ws)
        assert index.scan(ws) == got == all_matches(ws, index)


def test_every_place_of_a_template():
    line = licences.words("Released under the MIT license. ")
    got = licences.Index({}, 1).scan((line + [b"x"] * 9) * 3)
    assert [m[:2] for m in got if m[0] == "mit"] == [("mit", 0), ("mit", 14), ("mit", 28)]
