"""Removal of repeated passages of words with Aho-Corasick automata.

A window of ``length`` words is removed where it also starts earlier, by doc_id and place. Segments
(see anchors) that occur again as a whole are settled by their earliest occurrence. What is left,
distinct segments that share an anchor phrase, is dealt into shards by that anchor. A shard confirms
which windows recur, compiles them into automata of bounded size, and streams every segment that was
dealt to it through them, to locate every occurrence and find the earliest one of each.

An anchor with more than ``crowd`` distinct segments is not sent to one task: its windows are grouped
one by one, under two 64-bit hashes, by a distributed aggregation.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import anchors
from granary.llm.anchors import KEY, MARK_BITS, column_bytes, gathered, later, spans_hash, with_key, word_spans, word_symbols
from granary.llm.common import as_long, discard, lean, release, slices, staged, table
from granary.llm.suffix import SPAN, cover, runs, span_batch

LENGTH, GRAM, CROWD = 20, 6, 4096
PHRASES = 4000  # windows in an automaton
ROOM = 250_000  # bytes of segments held in a shard at once


def located(segments: list[tuple[int, int, int, int, str]], length: int) -> list[np.ndarray]:
    """Segments (doc, tag, place, windows, words joined by spaces) -> for each, which windows start earlier in another one."""
    keys, seen, again = [], set(), set()
    for *_, n, text in segments:
        padded = f" {text} "
        at = [k for k, c in enumerate(padded) if c == " "]
        own = [padded[at[k] : at[k + length] + 1] for k in range(n)]
        again.update(x for x in own if x in seen)
        seen.update(own)
        keys.append((padded, at))
    del seen
    out = [np.zeros(n, bool) for *_, n, _ in segments]
    phrases = sorted(again)
    for begin in range(0, len(phrases), PHRASES):
        machine = ahocorasick.Automaton()
        part = phrases[begin : begin + PHRASES]
        for k, p in enumerate(part):
            machine.add_word(p, (k, len(p)))
        machine.make_automaton()
        first: list = [None] * len(part)
        hits = []
        for s, (padded, at) in enumerate(keys):
            doc, tag, place, n, _ = segments[s]
            index = {c: k for k, c in enumerate(at[:n])}
            for end, (k, size) in machine.iter(padded):
                j = index[end - size + 1]
                where = (doc, tag, place + (j << MARK_BITS))
                hits.append((s, j, k, where))
                if first[k] is None or where < first[k]:
                    first[k] = where
        for s, j, k, where in hits:
            if where > first[k]:
                out[s][j] = True
    return out


def sharded(batches, length: int):
    """Segments sorted by anchor (fp, doc, tag, place, n, piece) -> runs of windows to remove, in portions of about ROOM bytes."""
    held, size, last = [], 0, None

    def solve():
        return span_batch([(doc, tag, place + (int(a) << MARK_BITS), int(b - a)) for (doc, tag, place, *_), flags in zip(held, located(held, length), strict=True) for a, b in zip(*runs(flags), strict=True)])

    for b in batches:
        for fp, *one in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if fp != last and size > ROOM:
                yield solve()
                held, size = [], 0
            last = fp
            held.append(one)
            size += len(one[4])
    if held:
        yield solve()
    held.clear()
    release()


def later_spans(keyed: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """KEY and the runs (place, n) of windows that also start earlier; a written table."""
    local, large, found, distinct, tables = anchors.repeated_segments(keyed, word_symbols, length, gram)
    first = distinct.filter("c > 1").select("fp", "whole", "twin", *[F.col(c).alias(f"{c}0") for c in ("doc", "tag", "place")])
    whole = found.join(first, ["fp", "whole", "twin"]).filter(later())

    wanted = gathered(distinct.filter("kinds > 1"), "fp", "place", "n", "kinds")

    def cut(batches):
        for b in slices(batches, 2, 1 << 18):
            data, offsets = column_bytes(b.column(2))
            begin, end, starts = word_spans(data, offsets)
            out = []
            for k, (doc, tag, parts) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                for p in parts:
                    a = starts[k] + (p["place"] >> MARK_BITS)
                    z = a + p["n"] - 2 + length
                    piece = b" ".join(data[begin[a] : end[z]].tobytes().split())
                    out.append((p["fp"], doc, tag, p["place"], p["n"], p["kinds"], piece))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            rows = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], ["fp", "doc", "tag", "place", "n", "kinds", "piece"])
            yield rows.set_column(6, "piece", rows.column(6).cast(pa.string()))

    pieces = keyed.join(wanted, KEY).select("doc", "tag", "text", "parts").mapInArrow(cut, "fp long, doc long, tag long, place long, n int, kinds long, piece string")
    few = pieces.filter(F.col("kinds") <= crowd).select("fp", "doc", "tag", "place", "n", "piece")
    met = few.repartition("fp").sortWithinPartitions("fp").mapInArrow(lambda batches: sharded(batches, length), SPAN)

    def single(batches):
        for b in slices(batches, 3, 1 << 18):
            h, g, starts = word_symbols(*column_bytes(b.column(3)))
            count = np.diff(starts) - length + 1
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(starts[:-1], count) + step
            own = [np.repeat(b.column(c).to_numpy(), count) for c in range(3)]
            yield pa.record_batch([pa.array(x) for x in (*(as_long(spans_hash(x, at, at + length)) for x in (h, g)), own[0], own[1], own[2] + (step << MARK_BITS))], ["one", "two", "doc", "tag", "place"])

    windows = pieces.filter(F.col("kinds") > crowd).select("doc", "tag", "place", "piece").mapInArrow(single, "one long, two long, doc long, tag long, place long")
    counted = windows.groupBy("one", "two").agg(F.min(F.struct("doc", "tag", "place")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    counted = counted.select("one", "two", *[F.col(f"first.{c}").alias(f"{c}0") for c in ("doc", "tag", "place")])
    crowded = windows.join(counted, ["one", "two"]).filter(later()).withColumn("n", F.lit(1))
    out = local.filter("local = 1").select("doc", "tag", "place", "n")
    for more in (whole, large.filter(later()), met, crowded):
        out = out.unionByName(more.select("doc", "tag", "place", "n"))
    out = staged(gathered(out, "place", "n"), "later-spans")
    discard(*tables)
    return out


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Every row of docs (doc_id, text; other columns are ignored) without the words of passages that start earlier.

    kept holds the remaining words joined by spaces. Null and empty texts have no words; of repeated
    rows (equal doc_id and text) each is kept alike; rows of one doc_id, or without one, are told
    apart by hashes of their texts, which order them too, and a null doc_id comes before all others.
    An empty table gives an empty one. A text is held whole by the task that cuts it (2 GB at most).
    """
    return with_passages_removed(docs, [], length, gram, crowd)


def with_passages_removed(docs: DataFrame, carried: list[str], length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """As remove_passages, with columns of docs carried along (as carried_0, carried_1, ...) and rest: the text without the removed words and the blanks behind them, so that its lines stay."""
    lean(docs.sparkSession)
    spans = later_spans(with_key(docs), length, gram, crowd)
    names = [f"carried_{k}" for k in range(len(carried))]
    header = [x.split()[0] for x in RESULT.split(", ")]

    def strip(batches):
        for b in slices(batches, 1, 1 << 18):
            data, offsets = column_bytes(b.column(1))
            begin, _, starts = word_spans(data, offsets)
            out = []
            for k, (doc, parts) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                n = int(starts[k + 1] - starts[k])
                text = data[offsets[k] : offsets[k + 1]]
                words, rest = text.tobytes().split(), None
                if parts:
                    gone = cover(parts, length, n)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    if names:
                        edge = np.append(begin[starts[k] : starts[k + 1]] - offsets[k], len(text))
                        gone = np.concatenate([np.zeros(edge[0], bool), np.repeat(gone, np.diff(edge))])
                        rest = text[~gone].tobytes().decode()
                kept = b" ".join(words)
                out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode(), rest))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.record_batch((made if names else made[:5]) + [b.column(k) for k in range(3, b.num_columns)], header + (["rest", *names] if names else []))

    rows = with_key(docs, *carried).join(spans, KEY, "left").select("doc_id", "text", "parts", *names)
    more = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carried, strict=True))
    return rows.mapInArrow(strip, RESULT + (", rest string" + more if names else ""))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT doc_id, k, array_to_string(words[k : k + 19], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 19, 0) + 1)) AS k FROM w)
), f AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) > 1 AS later FROM s
), g AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS at FROM f WHERE later
), h AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM w
), r AS (
  SELECT h.doc_id, count(*) AS n_words, count(g.at) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY h.at) FILTER (WHERE g.at IS NULL), '') AS kept
  FROM h LEFT JOIN g ON h.doc_id = g.doc_id AND h.at = g.at GROUP BY h.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""
