"""Removal of byte strings that occur again, by difference-cover suffix sorting.

Segments (see anchors) whose anchor occurs once hold no repeated string, and segments that occur again
as a whole are repeated from end to end. What is left, distinct segments that share an anchor, meets
in tasks by its anchor: there the suffixes of all segments are sorted by the difference cover modulo
three - triples at two of three places are sorted and named, the names are sorted by recursion until
a name covers the wanted length, the third of the suffixes left over is merged - and neighbours
that share ``length`` bytes are repeated.

An anchor with more than ``crowd`` distinct segments is not sent to one task: its windows are counted
one by one, under two 64-bit hashes, by a distributed aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import anchors
from granary.llm.anchors import KEY, MARK_BITS, OTHERS, SYMBOLS, byte_symbols, column_bytes, gathered, spans_hash, with_key
from granary.llm.common import as_long, discard, lean, release, slices, staged, table

LENGTH, GRAM, CROWD = 200, 64, 2048
ROOM = 800_000  # bytes sorted at once are about so many at most; places and names must stay below 2^20


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys below 2^42 and, in that order, where a new key begins; place and key are sorted as one number."""
    both = np.sort((key << 21) | np.arange(len(key)))
    own = both >> 21
    return both & ((1 << 21) - 1), np.concatenate([[True], own[1:] != own[:-1]]) if len(key) else np.zeros(0, bool)


def _names(key: np.ndarray) -> np.ndarray:
    """Ranks of the keys, from 1, equal keys alike."""
    order, new = _sorted(key)
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


def _smaller(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many of one are smaller than each of one, how many of two than each of one, and how many of one than each of two."""
    order, new = _sorted(np.concatenate([one, two]))
    mine = order < len(one)
    ahead = np.cumsum(mine) - mine
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    ones, all_before = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    ones[order] = ahead[group]
    all_before[order] = group
    n = len(one)
    return ones[:n], all_before[:n] - ones[:n], ones[n:]


def suffix_ranks(text: np.ndarray, reach: int) -> np.ndarray:
    """For each place of text (symbols from 1, fewer than 2^20) a number that orders the suffixes by their first ``reach`` symbols; suffixes alike so far may have different numbers, with none of another kind between them."""
    n = len(text)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    threes, ones, twos = np.arange(0, n, 3), np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    small = not n or int(text.max()) < 1 << 14
    pairs = (lambda at: (s[at] << 14) | s[at + 1]) if small else (lambda at: _names((s[at] << 21) | s[at + 1]))
    names = _names((pairs(sample) << (14 if small else 21)) | s[sample + 2])
    if len(sample) and names.max() < len(sample) and reach > 3:
        whole = np.concatenate([names[: len(ones)], [0], names[len(ones) :]])
        deep = suffix_ranks(whole + 1, -(-reach // 3))
        names = np.concatenate([deep[: len(ones)], deep[len(ones) + 1 :]]) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    # A suffix left over compares with a sampled one by one symbol and a rank, or by two and a rank.
    own, below1, above1 = _smaller((s[threes] << 21) | rank[threes + 1], (s[ones] << 21) | rank[ones + 1])
    third = np.concatenate([threes, twos])
    pair = _names((s[third] << 21) | s[third + 1]) << 21
    _, below2, above2 = _smaller(pair[: len(threes)] | rank[threes + 2], pair[len(threes) :] | rank[twos + 2])
    counts = np.bincount(names)
    sampled = (np.cumsum(counts) - counts)[names]
    out = np.empty(n, np.int64)
    out[threes] = own + below1 + below2
    out[ones] = sampled[: len(ones)] + above1
    out[twos] = sampled[len(ones) :] + above2
    return out


def repeated_windows(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of this length at each place (int64) is also at another of the places."""
    out = np.zeros(len(places), bool)
    if len(places) < 2:
        return out
    order = np.argsort(suffix_ranks(text.astype(np.int64) + 1, length)[places], kind="stable")
    at = places[order]
    a, b = at[:-1], at[1:]
    sums = spans_hash(SYMBOLS[text], at, at + length)
    near = np.flatnonzero(sums[:-1] == sums[1:])
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    for k in range(0, len(near), 4096):
        part = near[k : k + 4096]
        part = part[(view[a[part]] == view[b[part]]).all(axis=1)]
        out[order[part]] = out[order[part + 1]] = True
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


SPAN = "doc long, tag long, place long, n int"


def span_batch(spans: list[tuple]) -> pa.RecordBatch:
    """(doc, tag, place, n) tuples as a batch."""
    doc, tag, place, n = zip(*spans, strict=True) if spans else ((),) * 4
    return pa.record_batch([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int32())], ["doc", "tag", "place", "n"])


def sorted_groups(batches, length: int):
    """Segments sorted by anchor (fp, doc, tag, place, n, piece) -> repeated windows as (doc, tag, place, n), each task in portions of ROOM bytes."""
    held, size, last = [], 0, None

    def solve():
        text = np.concatenate([np.frombuffer(x[4], np.uint8) for x in held])
        lengths = np.array([len(x[4]) for x in held])
        begin = np.cumsum(lengths) - lengths
        count = np.array([x[3] for x in held])
        places = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        flags = repeated_windows(text, places, length)
        first = np.cumsum(count) - count
        return span_batch([(doc, tag, place + (int(a) << MARK_BITS), int(b - a)) for k, (doc, tag, place, n, _) in enumerate(held) for a, b in zip(*runs(flags[first[k] : first[k] + n]), strict=True)])

    for b in batches:
        for fp, *one in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if fp != last and size > ROOM // 2:
                yield solve()
                held, size = [], 0
            last = fp
            held.append(one)
            size += len(one[4])
    if held:
        yield solve()
    held.clear()
    release()


def repeated_spans(keyed: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """KEY and the runs (place, n) of windows of this length that start anywhere else too; a written table."""
    local, large, found, distinct, tables = anchors.repeated_segments(keyed, byte_symbols, length, gram)
    whole = found.join(distinct.filter("c > 1").select("fp", "whole", "twin"), ["fp", "whole", "twin"], "left_semi")
    # Rows that stand in the table more than once: each is repeated in the other.
    twice = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"), F.first(F.octet_length("text")).alias("size")).filter((F.col("c") > 1) & (F.col("size") >= length))
    twice = twice.select("doc", "tag", F.col("mark").alias("place"), (F.col("size") - length + 1).cast("int").alias("n"))

    wanted = gathered(distinct.filter("kinds > 1"), "fp", "place", "n", "kinds")

    def cut(batches):
        for b in slices(batches, 2, 1 << 18):
            out = []
            data, offsets = column_bytes(b.column(2))
            for k, (doc, tag, parts) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                for p in parts:
                    a = offsets[k] + (p["place"] >> MARK_BITS)
                    out.append((p["fp"], doc, tag, p["place"], p["n"], p["kinds"], data[a : a + p["n"] - 1 + length].tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], ["fp", "doc", "tag", "place", "n", "kinds", "piece"])

    pieces = keyed.join(wanted, KEY).select("doc", "tag", "text", "parts").mapInArrow(cut, "fp long, doc long, tag long, place long, n int, kinds long, piece binary")
    few = pieces.filter(F.col("kinds") <= crowd).select("fp", "doc", "tag", "place", "n", "piece")
    met = few.repartition("fp").sortWithinPartitions("fp").mapInArrow(lambda batches: sorted_groups(batches, length), SPAN)

    def single(batches):
        for b in slices(batches, 4, 1 << 16):
            data, offsets = column_bytes(b.column(4).cast(pa.large_binary()).view(pa.large_string()))
            count = b.column(3).to_numpy().astype(np.int64)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(offsets[:-1], count) + step
            made = [as_long(spans_hash(x[data], at, at + length)) for x in (SYMBOLS, OTHERS)]
            own = [np.repeat(b.column(c).to_numpy(), count) for c in range(3)]
            yield pa.record_batch([pa.array(x) for x in (*made, own[0], own[1], own[2] + (step << MARK_BITS))], ["one", "two", "doc", "tag", "place"])

    windows = pieces.filter(F.col("kinds") > crowd).select("doc", "tag", "place", "n", "piece").mapInArrow(single, "one long, two long, doc long, tag long, place long")
    counted = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("one", "two")
    crowded = windows.join(counted, ["one", "two"], "left_semi").withColumn("n", F.lit(1))
    out = twice
    for more in (local, whole, large, met, crowded):
        out = out.unionByName(more.select("doc", "tag", "place", "n"))
    out = staged(gathered(out, "place", "n"), "repeated-spans")
    discard(*tables)
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cover(parts: list[dict] | None, length: int, size: int) -> np.ndarray:
    """Which of ``size`` symbols are covered by the windows of runs (place, n)."""
    edge = np.zeros(size + 1, np.int32)
    if parts:
        begin = np.array([p["place"] for p in parts], np.int64) >> MARK_BITS
        n = np.array([p["n"] for p in parts], np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + n - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Every row of docs (doc_id, text; other columns are ignored) without the bytes of repeated strings.

    A byte is removed if a string of ``length`` bytes over it also starts anywhere else, in any row.
    kept holds the remaining bytes, n_spans counts maximal removed runs. Null and empty texts have no
    bytes; repeated rows lose all strings that are long enough, as each stands in the other; rows of
    one doc_id, or without one, are told apart by their texts. An empty table gives an empty one. A
    text is held whole by the task that cuts it (2 GB at most); equal strings inside a text are
    settled there, however many there are.
    """
    lean(docs.sparkSession)
    keyed = with_key(docs)
    spans = repeated_spans(keyed, length, gram, crowd)

    def strip(batches):
        for b in slices(batches, 1):
            out = []
            data, offsets = column_bytes(b.column(1))
            for k, (doc, parts) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                own = data[offsets[k] : offsets[k + 1]]
                gone = cover(parts, length, len(own))
                kept = own[~gone].tobytes()
                out.append((doc, len(own), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return keyed.join(spans, KEY, "left").select("doc_id", "text", "parts").mapInArrow(strip, RESULT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
