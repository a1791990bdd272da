"""Content-defined segments: where equal windows can be, found without comparing texts.

A window of ``length`` symbols is assigned to the smallest, leftmost hashed k-gram inside it, its
anchor. Equal windows have equal anchors at equal places. The windows of one anchor occurrence are
neighbours; they and the symbols they span are a segment, (anchor hash, two hashes of all its symbols,
row, first window, number of windows). Only segments whose anchor hash occurs again can
hold windows that occur again.

A row is known by doc_id and 96 bits of hashes of its text, so that rows of one doc_id, and rows
without one, are told apart; rows that are equal in both are one row. Segments and stretches are
equal where two 64-bit hashes from independent tables of symbols agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import as_long, discard, mix64, slices, staged

BASE = pow(0x9E3779B97F4A7C15, 5, 2**64) | 1
INVERSE = pow(BASE, -1, 2**64)
SYMBOLS = np.random.default_rng(20).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
OTHERS = np.random.default_rng(21).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Low bits of a place that hold bits of a second hash of the row's text.
MARK_BITS = 32
MARK = (1 << MARK_BITS) - 1
#: Orders null doc_ids before all others; never told apart by it, nor given back.
LEAST = -(2**63)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^j and BASE^-j modulo 2^64, for j up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        _powers[:] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, x, np.uint64))]) for x in (BASE, INVERSE)]
    return _powers[0][: n + 1], _powers[1][: n + 1]


def spans_hash(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of symbols (uint64, well mixed), by prefix sums."""
    up, down = powers(len(symbols))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(symbols * up[:-1], dtype=np.uint64)])
    return mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k symbols in a row, from hashes of one."""
    at, out, done = h, None, 0
    size = 1
    while size <= k:
        if k & size:
            out = at if out is None else _join(out[: len(out) - size], at[done:])
            done += size
        size *= 2
        if size <= k:
            at = _join(at[: len(at) - size // 2], at[size // 2 :])
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xD6E8FEB86659FD93) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    return x


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each value begins (and the last ends); nulls are empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than blanks) of values one after the other: hash, first byte, end, and where each value's words begin."""
    begin, end, starts = word_spans(data, offsets)
    return spans_hash(SYMBOLS[data], begin, end), begin, end, starts


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and where each value's words begin."""
    word = ~SPACE[data]
    first = word.copy()
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    begin = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    end = np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, offsets)


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every byte, and where values begin."""
    return SYMBOLS[data], OTHERS[data], offsets


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word, and where values begin."""
    begin, end, starts = word_spans(data, offsets)
    return spans_hash(SYMBOLS[data], begin, end), spans_hash(OTHERS[data], begin, end), starts


def segments(h: np.ndarray, g: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Segments of values whose symbol hashes (h, and g from another table) stand one after the other: value, first window (in the value), number of windows, anchor hash, two hashes of all symbols."""
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, none, none, *[none.astype(np.uint64)] * 3
    gram = mix64(grams(h, k))
    key = (gram & ~np.uint64(0xFFFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    span, low, size = length - k + 1, key, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.diff(starts)
    value = np.repeat(np.arange(len(counts)), counts)[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= starts[1:][value]
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | (value[1:] != value[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(first)
    ends = np.flatnonzero(valid & ~np.concatenate([valid[1:] & ~first[1:], [False]]))
    n = ends - begin + 1
    own = value[begin]
    # The anchor's place among the segment's symbols belongs to what must be equal.
    inside = (anchor[begin] - begin).astype(np.uint64)
    whole, twin = (mix64(spans_hash(x, begin, begin + n - 1 + length) + inside) for x in (h, g))
    return own, begin - starts[own], n, gram[anchor[begin]], whole, twin


def with_key(docs: DataFrame, *carried: str) -> DataFrame:
    """doc, tag, mark, doc_id, text, and other columns as carried_0, carried_1, ...: doc orders the rows (null first), and with tag and mark (64 and 32 bits of hashes) tells them apart."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc = docs["doc_id"].cast("long")
    return docs.select(
        F.coalesce(doc, F.lit(LEAST)).alias("doc"),
        F.xxhash64(text, docs["doc_id"].isNull()).alias("tag"),
        F.hash(text).cast("long").bitwiseAND(F.lit(MARK)).alias("mark"),
        doc.alias("doc_id"),
        text.alias("text"),
        *[docs[c].alias(f"carried_{k}") for k, c in enumerate(carried)],
    )


KEY = ["doc", "tag", "mark"]
SEGMENT = "fp long, whole long, twin long, doc long, tag long, place long, n int"


def segment_rows(keyed: DataFrame, symbols: Callable, length: int, k: int) -> DataFrame:
    """A row per segment; place: the first window, shifted by MARK_BITS, and the mark. symbols: (bytes, offsets) -> (hashes, other hashes, starts)."""

    def rows(batches):
        for b in slices(batches, 3, 1 << 18):
            own, first, n, *hashes = segments(*symbols(*column_bytes(b.column(3))), length, k)
            doc, tag, mark = (b.column(c).to_numpy()[own] for c in range(3))
            made = [*map(as_long, hashes), doc, tag, (first << MARK_BITS) | mark, n.astype(np.int32)]
            yield pa.record_batch([pa.array(x) for x in made], [x.split()[0] for x in SEGMENT.split(", ")])

    return keyed.select(*KEY, "text").mapInArrow(rows, SEGMENT)


STRETCH = 4  # segments in a stretch, on average
PART = "struct<fp:long,whole:long,twin:long,n:int>"


def stretches(found: DataFrame) -> DataFrame:
    """Segments of a row that follow one another, joined into stretches: code, twin, doc, tag, place, n, parts (fp, whole, twin, n), local.

    What repeats inside a row is settled there: of equal segments of a row only the first belongs to a
    stretch; a row of its own, with local = 1, stands for each further one, and one with local = 2
    says that the first one has such followers. A stretch ends after a segment whose hash says so, so
    that equal passages fall into equal stretches but for their ends. code and twin hash all its segments.
    """
    per = gathered(found, "fp", "whole", "twin", "place", "n")

    def rows(batches):
        for b in batches:
            parts = b.column(3)
            flat = parts.flatten()
            if not len(flat):
                continue
            fp, whole, twin, place, n = (flat.field(k).to_numpy().astype(np.int64) for k in range(5))
            row = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy())
            order = np.lexsort((place, row))
            fp, whole, twin, place, n, row = (x[order] for x in (fp, whole, twin, place, n, row))
            order = np.lexsort((fp, twin, whole, row))  # stable: by place among equal ones
            same = np.all([x[order][1:] == x[order][:-1] for x in (row, fp, whole, twin)], axis=0)
            later, before = np.zeros(len(row), bool), np.zeros(len(row), bool)
            later[order[1:][same]] = True
            before[order[:-1][same]] = True
            before &= ~later
            at = np.flatnonzero(~later)
            first = np.ones(len(at), bool)
            first[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + (n[at[:-1]] << MARK_BITS)) | (whole[at[:-1]] % STRETCH == 0)
            begin = np.flatnonzero(first)
            end = np.append(begin[1:], len(at))
            one, two = (mix64(fp[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x[at].view(np.uint64)) for x in (whole, twin))
            code, other = spans_hash(one, begin, end), spans_hash(two, begin, end)
            own = pa.StructArray.from_arrays([pa.array(fp[at]), pa.array(whole[at]), pa.array(twin[at]), pa.array(n[at].astype(np.int32))], ["fp", "whole", "twin", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), own)
            key = [b.column(c).to_numpy() for c in range(2)]
            head = at[begin]
            names = ["code", "twin", "doc", "tag", "place", "n", "parts", "local"]
            yield pa.record_batch([pa.array(as_long(code)), pa.array(as_long(other)), *(pa.array(x[row[head]]) for x in key), pa.array(place[head]), pa.array(np.add.reduceat(n[at], begin).astype(np.int32)), lists, pa.array(np.zeros(len(head), np.int32))], names)
            head = np.flatnonzero(later | before)
            if len(head):
                kinds = np.where(later[head], 1, 2).astype(np.int32)
                nothing = np.zeros(len(head), np.int64)
                yield pa.record_batch([pa.array(nothing), pa.array(nothing), *(pa.array(x[row[head]]) for x in key), pa.array(place[head]), pa.array(n[head].astype(np.int32)), pa.nulls(len(head), lists.type), pa.array(kinds)], names)

    return per.select(*KEY, "parts").mapInArrow(rows, f"code long, twin long, doc long, tag long, place long, n int, parts array<{PART}>, local int")


def repeated_segments(keyed: DataFrame, symbols: Callable, length: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """What is repeated in the large, what is left of it, and a row per distinct segment that is left.

    Only segments whose anchor hash occurs again are looked at. The first table has what repeats inside
    rows: doc, tag, place, n, local. The second has the occurrences of stretches that occur again: doc,
    tag, place, n, and doc0, tag0, place0 of the earliest one. The third has the segments (fp, whole,
    twin, doc, tag, place, n) of the earliest occurrence of every stretch. The fourth has, for each
    distinct one of these, c, how often it occurs there, doc, tag, place and n of the earliest one, and
    kinds, how many distinct segments its anchor has. Last come the tables that these read. The counts are combined before they are
    shuffled, and written, so that the joins read plain shuffles, whose hot keys the adaptive planner splits.
    """
    rows = segment_rows(keyed, symbols, length, k)
    again = staged(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("fp"), "repeated-anchors")
    every = staged(stretches(rows.join(again, "fp")), "stretches")
    discard(again)
    local, long = every.filter("local > 0").select("doc", "tag", "place", "n", "local"), every.filter("local = 0")
    first = long.groupBy("code", "twin").agg(F.min(F.struct("doc", "tag", "place")).alias("first"), F.count(F.lit(1)).alias("c"), F.first("parts").alias("parts"))
    first = staged(first.select("code", "twin", *[F.col(f"first.{c}").alias(f"{c}0") for c in ("doc", "tag", "place")], "c", "parts"), "distinct-stretches")
    large = long.select("code", "twin", "doc", "tag", "place", "n").join(first.filter("c > 1").select("code", "twin", "doc0", "tag0", "place0"), ["code", "twin"])

    ends = F.aggregate("parts", F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["n"])))
    found = first.select("doc0", "tag0", "place0", F.explode(F.zip_with("parts", ends, lambda p, at: F.struct(p.alias("p"), at.alias("at")))).alias("s")).filter("s.p is not null")
    found = found.select("s.p.fp", "s.p.whole", "s.p.twin", F.col("doc0").alias("doc"), F.col("tag0").alias("tag"), (F.col("place0") + F.shiftleft("s.at", MARK_BITS)).alias("place"), "s.p.n")
    found = staged(found, "segments")
    distinct = found.groupBy("fp", "whole", "twin").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "tag", "place", "n")).alias("first"))
    distinct = staged(distinct.select("fp", "whole", "twin", "c", "first.*"), "distinct-segments")
    kinds = staged(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "anchor-kinds")
    return local, large, found, distinct.join(kinds, "fp", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1))), [every, first, found, distinct, kinds]


def later():
    """Whether a row's place comes after doc0, tag0, place0."""
    return F.struct("doc", "tag", "place") > F.struct("doc0", "tag0", "place0")


def gathered(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows with doc, tag and place -> doc, tag, mark and the distinct entries of the fields; as many as a text has segments at most, however often a row is repeated."""
    return rows.groupBy("doc", "tag", F.col("place").bitwiseAND(F.lit(MARK)).alias("mark")).agg(F.collect_set(F.struct(*fields)).alias("parts"))
