"""Licence scan with a positional index of rare template words.

Each template is indexed under its rarest words, by inverse document frequency over the whole
corpus. A text's licence words are looked up, rarest first; each posting votes for the place where
its template would begin, and votes of several words for one place make a candidate. A candidate is
accepted if the template's mandatory key phrases stand at their places, up to ``slack`` words away.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import lean, slices, table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # on lower-cased UTF-8; the bytes of all characters beyond ASCII are from 80 on
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence notices (fixed texts) and the phrases that must be there.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license", "apache org licenses"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "obtaining a copy"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it", "gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "this work has been dedicated to the public domain under the creative commons zero dedication", ["public domain", "creative commons zero"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "provided that the following conditions"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute", "with or without fee"]),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["the software is provided as is", "merchantability fitness for a particular purpose and noninfringement"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of", "endorse or promote products derived from this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("reserved", "copyright all rights reserved", ["all rights reserved"]),
    ("proprietary", "this document is confidential and proprietary and may not be reproduced without written permission", ["confidential and proprietary"]),
]


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def places(ws: list[bytes], phrase: list[bytes]) -> list[int]:
    n, out, at = len(phrase), [], 0
    while True:
        try:
            at = ws.index(phrase[0], at)
        except ValueError:
            return out
        if ws[at : at + n] == phrase:
            out.append(at)
        at += 1


class Index:
    """The templates under their ``keys`` rarest words; at least ``votes`` of these, or all, must agree on a place."""

    def __init__(self, frequency: dict[bytes, int], total: int, keys: int = 4, votes: int = 2, slack: int = 2, stretch: int = 20_000):
        self.slack, self.stretch, self.postings, self.templates = slack, stretch, defaultdict(list), []
        self.idf = lambda w: math.log((total + 1) / (frequency.get(w, 0) + 1))
        self.base = [(p.encode().split(), label) for p, label in BASE.items()]
        for k, (label, text, phrases) in enumerate(TEMPLATES):
            ws = text.encode().split()
            rare = sorted(set(ws), key=lambda w: (-self.idf(w), w))[:keys]
            self.templates.append((label, ws, [(places(ws, p), p) for p in (x.encode().split() for x in phrases)], min(votes, len(rare))))
            for at, w in enumerate(ws):
                if w in rare:
                    self.postings[w].append((k, at))

    def scan(self, ws: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, first word, share of the template's words at their places) of every accepted match, all places of a template."""
        present = set(ws).intersection(self.postings)
        if not present:
            return []
        where = defaultdict(list)
        for at, w in enumerate(ws):
            if w in present:
                where[w].append(at)
        rare = sorted(present, key=lambda w: (-self.idf(w), w))
        longest = max(len(t[1]) for t in self.templates)
        out: list[tuple[str, int, float]] = []
        ends: dict[int, tuple[int, float]] = {}  # of each template, the last match and its share
        # Begins are looked for stretch by stretch, so that votes never need more room than one of them.
        for low in range(-self.slack - longest, len(ws), self.stretch):
            high = low + self.stretch
            agree = defaultdict(set)
            for w in rare:
                own = where[w]
                for at in own[bisect_left(own, low - self.slack) : bisect_left(own, high + longest + self.slack)]:
                    for k, place in self.postings[w]:
                        for begin in range(max(low, at - place - self.slack), min(high, at - place + self.slack + 1)):
                            agree[k, begin].add(w)
            for (k, begin), found in sorted(agree.items(), key=lambda x: x[0]):
                label, template, phrases, votes = self.templates[k]
                if len(found) < votes or not all(self._near(ws, begin, own, p) for own, p in phrases):
                    continue
                share = sum(0 <= begin + j < len(ws) and ws[begin + j] == w for j, w in enumerate(template)) / len(template)
                # Begins up to the slack apart are one match, at the best of them.
                if k in ends and begin - ends[k][0] <= 2 * self.slack:
                    if share <= ends[k][1]:
                        continue
                    out = [m for m in out if m[:2] != (k, ends[k][0])]
                ends[k] = begin, share
                out.append((k, begin, share))
        return [(self.templates[k][0], begin, share) for k, begin, share in sorted(out)]

    def _near(self, ws: list[bytes], begin: int, own: list[int], p: list[bytes]) -> bool:
        """Whether a phrase stands at one of its places in the template, up to the slack away."""
        return any(ws[a : a + len(p)] == p for at in own for a in range(max(0, begin + at - self.slack), begin + at + self.slack + 1))


def template_words() -> frozenset[bytes]:
    return frozenset(w for _, text, _ in TEMPLATES for w in text.encode().split())


def word_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many rows of docs each template word stands, and the number of rows; as many numbers as template words."""

    def count(batches):
        known, found, n = template_words(), defaultdict(int), 0
        for b in slices(batches, 0):
            for t in b.column(0).to_pylist():
                n += 1
                for w in known.intersection(words(t)):
                    found[w] += 1
        out = [(w.decode(), k) for w, k in found.items()] + [("", n)]
        yield pa.record_batch([pa.array([x for x, _ in out]), pa.array([x for _, x in out], pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word.encode(): r.n for r in rows}
    return found, found.pop(b"", 0)


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,word:long,share:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """Licences in every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no words and no labels; repeated rows give repeated results; an empty
    table gives an empty one. score is the largest share among accepted templates, 0.5 for base phrases
    alone, else 0. matches has every place of every template. A text is held whole by its task (2 GB at most).
    """
    lean(docs.sparkSession)
    index_of = word_frequencies(docs)

    def rows(batches):
        index = Index(*index_of)
        heads = {p[0] for p, _ in index.base}
        for b in slices(batches, 1):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                at, base = [], set()
                if not heads.isdisjoint(ws):
                    for p, label in index.base:
                        if found := places(ws, p):
                            at += found
                            base.add(label)
                matches = index.scan(ws)
                labels = base | {m[0] for m in matches}
                score = max((m[2] for m in matches), default=0.5 if base else 0.0)
                out.append((doc, len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip(("label", "word", "share"), m, strict=True)) for m in matches]))
            match = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), match]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, RESULT)


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("matches")
