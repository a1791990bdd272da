"""SentencePiece BPE with seeded merge-dropout.

Words are merged from an agenda of candidate merges, best score first, as the model's own encoder
does; a candidate that comes up is skipped when a keyed hash of seed, doc_id, text, number of the word
in the text, place and piece falls below the dropout rate. So a word is segmented anew wherever it stands.

What does not depend on the key is kept: the course that the agenda takes after each skip that has
been met, as a tree for every word. A node holds the candidates that come up from there on if none
is skipped, and the ids in the end. Many words go down their trees in step: one pass tests all
candidates of all words, the next one only those of words that have skipped one, from the node behind it.

Decoding gives back every text exactly: unknown characters, and the space mark itself where a text
holds it, are coded as bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import lean, mix64, release, slices, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Nodes of trees that are kept, at most.
LARGEST_CACHE = 600_000
#: Longer words, and those that skip a later candidate than this, are merged one by one.
LONGEST_KEPT = 48
STEPS = 63
ODD = 0x9E3779B97F4A7C15
WORDS_AT_ONCE = 8192
NONE = np.int32(2**31 - 1)
EMPTY = np.iinfo(np.int64).min
U = np.uint64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mixed(x: int) -> int:
    """mix64 of one number."""
    x ^= x >> 31
    x = x * 0x9E3779B97F4A7C15 & 2**64 - 1
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 & 2**64 - 1
    return x ^ x >> 32


def _fields(data: bytes):
    """Field number and value (bytes, integers) of a protocol buffer."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class Pieces:
    """A BPE model with byte fallback, read from a SentencePiece model file."""

    def __init__(self, model: bytes, seed: int = 0, rate: float = 0.1):
        self.seed, self.rate = seed, int(rate * 2**32)
        self.pieces, self.scores, self.kinds = [], [], []
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, 1))
        self.normal = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] in (1, 4)}
        self.byte = {}
        for k, p in enumerate(self.pieces):
            if self.kinds[k] == 6:
                self.byte[int(p[1:-1], 16)] = k
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.of_byte = np.array([self.byte[b] for b in range(256)], np.int32)
        self._pairs()
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.normal)  # else no merge crosses a word
        self.values = {k: b for b, k in self.byte.items()}
        self.shown: tuple[np.ndarray, ...] | None = None
        self.trees = Trees()

    def _pairs(self) -> None:
        """A hash table from two symbols (pieces, or characters that are none) to the piece they make, and ranks of the pieces by score."""
        self.symbol = dict(self.normal)
        for p in self.normal:
            for c in p:
                self.symbol.setdefault(c, len(self.pieces) + len(self.symbol) - len(self.normal))
        left, right, made = [], [], []
        for p, k in self.normal.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(k)
        own = np.unique(-np.array(self.scores))
        self.rank = np.searchsorted(own, -np.array(self.scores)).astype(np.int32)
        self.bits = max(10, (4 * len(made)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, EMPTY, np.int64), np.zeros(1 << self.bits, np.int32)
        self.probes = 0
        todo, made, probe = (np.array(left, np.int64) << 32) | np.array(right, np.int64), np.array(made, np.int32), 0
        while len(todo):
            at = (self._slot(todo) + probe) & ((1 << self.bits) - 1)
            _, first = np.unique(at, return_index=True)
            put = first[self.keys[at[first]] == EMPTY]
            self.keys[at[put]], self.made[at[put]] = todo[put], made[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, made = todo[rest], made[rest]
            probe += 1
        self.probes = probe

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, else -1."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = self._slot(key)
        found = self.keys.take(at)
        out = np.where(found == key, self.made.take(at), np.int32(-1))
        todo = np.flatnonzero((found != key) & (found != EMPTY))
        mask = (1 << self.bits) - 1
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & mask
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.made[at[todo[hit]]]
            todo = todo[~hit & (found != EMPTY)]
        return out

    def merge_many(self, words: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words and, as bits of a number, the candidates they skip by their turn: all ids, how many each has, all candidates in turn (place and piece), how many each has.

        Shorter words come first in the results; words must be sorted by length.
        """
        found = []
        for begin in range(0, len(words), WORDS_AT_ONCE):
            texts = words[begin : begin + WORDS_AT_ONCE]
            size = np.array([len(t) for t in texts])
            # A row per word, with a place before and one behind; all places in one dimension.
            rows, width = len(texts), int(size.max()) + 2
            inside = (np.arange(width) >= 1) & (np.arange(width) <= size[:, None])
            codes, place = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
            sym = np.full(rows * width, -1, np.int32)
            sym[inside.reshape(-1)] = np.array([self.symbol.get(chr(c), -1) for c in codes.tolist()], np.int32)[place]
            char = np.zeros(rows * width, np.uint32)
            char[inside.reshape(-1)] = codes[place]
            skip = skips[begin : begin + WORDS_AT_ONCE]
            piece = np.full(rows * width, -1, np.int32)  # of a place and the next one
            piece[:-1] = self._joined(sym[:-1], sym[1:])
            rank = np.where(piece >= 0, self.rank[piece], NONE)
            after, before = np.arange(1, rows * width + 1), np.arange(-1, rows * width - 1)
            alive, best, turn, came = np.arange(rows), rank.reshape(rows, width), 0, []
            while len(alive):
                a = best[alive].argmin(axis=1)
                i = alive * width + a
                more = rank[i] != NONE
                alive, a, i = alive[more], a[more], i[more]
                p = piece[i]
                came.append((alive, ((a.astype(np.uint64) - U(1)) << U(32)) | p.astype(np.uint64)))
                rank[i] = NONE
                go = ((skip[alive] >> U(turn)) & U(1)) == 0 if turn <= STEPS else np.ones(len(alive), bool)
                turn += 1
                i, p = i[go], p[go]
                b = after[i]
                c, z = after[b], before[i]
                sym[i], sym[b], rank[b], after[i], before[c] = p, -2, NONE, c, i
                made = self._joined(np.concatenate([p, sym[z]]), np.concatenate([sym[c], p]))
                at = np.concatenate([i, z])
                piece[at], rank[at] = made, np.where(made >= 0, self.rank[made], NONE)
            row = np.concatenate([x for x, _ in came])
            candidates = np.concatenate([x for _, x in came])[np.argsort(row, kind="stable")]
            kept = np.flatnonzero(inside.reshape(-1) & (sym != -2))
            ids, own = sym[kept], kept // width
            other = np.flatnonzero((ids < 0) | (ids >= len(self.pieces)))
            if len(other):  # single characters that are no pieces, in UTF-8
                c = char[kept[other]]
                n = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
                times = np.ones(len(ids), np.int64)
                times[other] = n
                step = ragged(np.zeros(len(n), np.int64), n)
                c, n = np.repeat(c, n), np.repeat(n, n)
                head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
                byte = ((c >> (6 * (n - 1 - step)).astype(np.uint32)) & np.where((step == 0) & (n == 1), 0x7F, 0x3F)) | np.where(step == 0, head, 0x80)
                marked = np.zeros(len(ids), bool)
                marked[other] = True
                ids, own, marked = np.repeat(ids, times), np.repeat(own, times), np.repeat(marked, times)
                ids[marked] = self.of_byte[byte]
            found.append((ids, np.bincount(own, minlength=rows), candidates, np.bincount(row, minlength=rows)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _bytes(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode("utf-8", "surrogatepass")]

    def merge(self, word: str, key: int | None) -> tuple[int, ...]:
        """ids of a word that stands where key says; key None: without dropout."""
        whole = self.normal.get(word)
        part = list(word)
        normal, scores = self.normal, self.scores
        n = len(part)
        if n == 1:
            return (whole,) if whole is not None else tuple(self._bytes(word))
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for k in range(n - 1):
            p = normal.get(part[k] + part[k + 1])
            if p is not None:
                agenda.append((-scores[p], k, k + 1, p))
        heapify(agenda)
        while agenda:
            _, a, b, p = heappop(agenda)
            left, right = part[a], part[b] if b < n else None
            if left is None or right is None or after[a] != b or normal.get(left + right) != p:
                continue
            if key is not None and _mixed(key ^ (a << 32 | p) * ODD & 2**64 - 1) >> 32 < self.rate:
                continue
            part[a] = left + right
            part[b] = None
            c = after[b]
            after[a] = c
            if c < n:
                before[c] = a
                q = normal.get(part[a] + part[c])
                if q is not None:
                    heappush(agenda, (-scores[q], a, c, q))
            z = before[a]
            if z >= 0:
                q = normal.get(part[z] + part[a])
                if q is not None:
                    heappush(agenda, (-scores[q], z, a, q))
        out = []
        for x in part:
            if x is not None:
                p = normal.get(x)
                if p is None:
                    out += self._bytes(x)
                else:
                    out.append(p)
        return tuple(out)

    def words(self, text: str) -> list[str | None]:
        """The words of a text, each with the marks before it; None stands for a mark that is in the text. A leading mark is added, as the model does."""
        if not text:
            return []
        cut = (lambda x: [x] if x else []) if self.whole else CHUNK.findall
        first, *rest = text.split(MARK)
        out: list[str | None] = cut(MARK + first.replace(" ", MARK))
        for x in rest:
            out.append(None)
            out += cut(x.replace(" ", MARK))
        return out

    def encode(self, text: str, key: int | None = None) -> list[int]:
        """ids of a text, word by word; the empty text has none. key: of the text, None: without dropout."""
        out: list[int] = []
        for k, w in enumerate(self.words(text)):
            out += self._bytes(MARK) if w is None else self.merge(w, None if key is None else _mixed(key + (k + 1) * ODD & 2**64 - 1))
        return out

    def encode_many(self, texts: list[str], keys: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for many texts: the ids one after the other, and where each text's begin (and the last one's end)."""
        trees = self.trees
        if trees.n > LARGEST_CACHE:
            trees = self.trees = Trees()
        words: list[str | None] = []
        counts = []
        for t in texts:
            own = self.words(t)
            words += own
            counts.append(len(own))
        new = set(words).difference(trees.root)
        if None in new:
            mark = np.array(self._bytes(MARK), np.int32)
            trees.root[None] = trees.add(mark, np.array([len(mark)]), np.zeros(0, U), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, U))
        new = sorted((w for w in new if w is not None and len(w) <= LONGEST_KEPT), key=len)
        if new:
            none = np.zeros(len(new), U)
            first = trees.add(*self.merge_many(new, none), none.astype(np.int64), none)
            trees.root.update(zip(new, range(first, first + len(new)), strict=True))
        node = np.array(list(map(trees.root.get, words, repeat(-1))), np.int64)
        counts = np.array(counts, np.int64)
        begin = np.cumsum(counts) - counts
        key = None
        if keys is not None:
            number = np.arange(len(words), dtype=np.uint64) - np.repeat(begin, counts).astype(np.uint64)
            key = mix64(np.repeat(np.array(keys, np.uint64), counts) + (number + U(1)) * U(ODD))
            self._walk(words, node, key)
        alone = np.flatnonzero(node < 0)
        single = [np.array(self.merge(words[k], None if key is None else int(key[k])), np.int32) for k in alone.tolist()]
        ids, low, n = np.concatenate([trees.ids[: trees.ids_end], *single]), trees.low[node], trees.size[node]
        n[alone] = [len(x) for x in single]
        low[alone] = trees.ids_end + np.cumsum(n[alone]) - n[alone]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids[ragged(low, n)], ends[np.append(begin, len(words))]

    def _walk(self, words: list[str | None], node: np.ndarray, key: np.ndarray) -> None:
        """Move every word (node) to the node where it skips nothing more; -1 if no node can say so."""
        trees = self.trees
        at = np.flatnonzero(node >= 0)
        while len(at):
            n = trees.turns[node[at]]
            place = ragged(trees.turn[node[at]], n)
            skip = np.flatnonzero((mix64(np.repeat(key[at], n) ^ trees.candidates[place]) >> U(32)) < U(self.rate))
            owner = np.repeat(np.arange(len(at)), n)[skip]
            first = np.ones(len(owner), bool)
            first[1:] = owner[1:] != owner[:-1]
            skip, owner = skip[first], owner[first]
            at, before = at[owner], node[at[owner]]
            turn = trees.past[before] + place[skip] - trees.turn[before]
            late = turn >= STEPS
            node[at[late]] = -1
            at, before, turn = at[~late], before[~late], turn[~late]
            step, inverse = np.unique(before * 64 + turn, return_inverse=True)
            found = np.array([trees.child.get(x, -1) for x in step.tolist()], np.int64)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                one = [words[k] for k in at[np.unique(inverse, return_index=True)[1][missing]].tolist()]
                order = sorted(range(len(one)), key=lambda k: len(one[k]))
                missing = missing[order]
                past = step[missing] & 63
                masks = trees.mask[step[missing] >> 6] | (U(1) << past.astype(U))
                first = trees.add(*self.merge_many([one[k] for k in order], masks), past + 1, masks)
                found[missing] = np.arange(first, first + len(missing))
                trees.child.update(zip(step[missing].tolist(), range(first, first + len(missing)), strict=True))
            node[at] = found[inverse]

    def decode(self, ids: list[int]) -> str:
        data, _ = self.decode_many(np.array(ids, np.int64), np.array([0, len(ids)]))
        return data[1:].decode("utf-8", "surrogatepass")

    def decode_many(self, ids: np.ndarray, begin: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of texts, each with one mark before it, and where they begin (and the last one ends). begin: where the ids of each begin."""
        if self.shown is None:
            shown = [bytes([self.values[k]]) if k in self.values else p.replace(MARK, " ").encode() for k, p in enumerate(self.pieces)]
            size = np.array([len(x) for x in shown])
            self.shown = np.frombuffer(b"".join(shown), np.uint8), np.cumsum(size) - size, size
        data, low, size = self.shown
        n = size[ids]
        return data[ragged(low[ids], n)].tobytes(), np.concatenate([[0], np.cumsum(n)])[begin]


def ragged(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... n times each, one after the other."""
    out = np.repeat(low - (np.cumsum(n) - n), n)
    return out + np.arange(len(out))


class Trees:
    """Nodes: ids from low on (size), candidates from turn on (turns), how many came up before, skipped ones as bits, children by node and turn."""

    NODE = ("low", "size", "turn", "turns", "past", "mask")

    def __init__(self):
        self.n = self.ids_end = self.candidates_end = 0
        for name in self.NODE:
            setattr(self, name, np.zeros(1 << 12, U if name == "mask" else np.int64))
        self.ids, self.candidates = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, U)
        self.root: dict[str | None, int] = {}
        self.child: dict[int, int] = {}

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        kept = getattr(self, name)
        if at + len(values) > len(kept):
            kept = np.concatenate([kept, np.zeros(max(len(kept), len(values)), kept.dtype)])
            setattr(self, name, kept)
        kept[at : at + len(values)] = values

    def add(self, ids: np.ndarray, n: np.ndarray, candidates: np.ndarray, turns: np.ndarray, past: np.ndarray, mask: np.ndarray) -> int:
        """New nodes, and the number of the first one; of each one's candidates those after the first ``past`` are kept."""
        left = turns - past
        candidates = candidates[ragged(np.cumsum(turns) - left, left)] * U(ODD)
        made = (self.ids_end + np.cumsum(n) - n, n, self.candidates_end + np.cumsum(left) - left, left, past, mask)
        for name, values in zip(self.NODE, made, strict=True):
            self._put(name, self.n, values)
        self._put("ids", self.ids_end, ids)
        self._put("candidates", self.candidates_end, candidates)
        first, self.n = self.n, self.n + len(n)
        self.ids_end, self.candidates_end = self.ids_end + len(ids), self.candidates_end + len(candidates)
        return first


RESULT = "doc_id long, n_bytes long, n_tokens long, ids array<int>, ids_sha256 string, lossless boolean"


def encode_documents(docs: DataFrame, model: str | None = None, seed: int = 0, rate: float = 0.1) -> DataFrame:
    """ids of every row of docs (doc_id, text; other columns are ignored), checked by decoding.

    Null and empty texts have no ids (and are lossless); rows that are equal in doc_id and text get
    equal ids, all others are cut independently, rows without a doc_id too. An empty table gives an
    empty one. A text is held whole by its task (2 GB at most). The model file is read by the driver and
    sent to the tasks.
    """
    lean(docs.sparkSession)
    with open(model or default_model(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [x.split()[0] for x in RESULT.split(", ")]

    def rows(batches):
        pieces = Pieces(shared.value, seed, rate)
        for b in slices(batches, 1, 1 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            raw = [t.encode() for t in texts]
            keys = [xxhash.xxh64_intdigest(r, xxhash.xxh64_intdigest(b"-" if doc is None else b"%d" % doc, seed)) for doc, r in zip(b.column(0).to_pylist(), raw, strict=True)]
            ids, begin = pieces.encode_many(texts, keys)
            data, at = pieces.decode_many(ids, begin)
            ids = ids.astype("<i4")
            spans = list(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))
            digests = [hashlib.sha256(ids[a:z]).hexdigest() for a, z in spans]
            same = [data[a + 1 : z] == r if z > a else not r for a, z, r in zip(at[:-1].tolist(), at[1:].tolist(), raw, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids, pa.int32()))
            made = [b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(np.diff(begin)), lists, pa.array(digests), pa.array(same)]
            yield pa.record_batch(made, names)
        del pieces
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, RESULT)


def decode_ids(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give a null text."""
    with open(model or default_model(), "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches):
        pieces = Pieces(shared.value)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([None if x is None else pieces.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(rows, "doc_id long, text string")


def op9_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents")).drop("ids")
