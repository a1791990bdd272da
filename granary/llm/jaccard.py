"""Exact Jaccard self-join on word shingles by partitioning the universe of shingles.

Two sets that reach the similarity differ in a bounded number H of shingles. In a size band with this
bound, hashing deals the shingles into m > H segments; similar sets agree on all but H of them. Every
set is indexed under the hash of each of its segments. As m is larger than H + 1, a query may skip
segments: it skips the keys that most sets share, up to m - H - 1 of them (cost-based allocation),
and still meets every similar set. A quarter of H segments more than are needed make few keys more, and
let queries skip nearly all keys that unlike sets share. Where H is one, the set is one segment, indexed with its
one-deletion neighbourhood instead. Sets whose sizes fall into neighbouring bands meet in the upper
one. Equal sets are one class from the start, and candidates are verified on the whole sets.

Links are needed as components only, so that a key shared by many sets doesn't give all pairs of
them: first, sets are checked against the smallest class of their keys, the one they share most keys
with; then against the rest of these and a few others of each key; at last all pairs that are in
different components still. Before a pair is formed, sketches of parities show whether the sets can be
similar at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.anchors import KEY, LOWER, column_bytes, grams, spans_hash, with_key, words_of
from granary.llm.common import as_long, discard, forget, lean, mix64, slices, staged, table
from granary.llm.components import components

RATIO = 1.6
EDGES = np.unique(np.ceil(RATIO ** np.arange(0, 60)).astype(np.int64))
U = np.uint64
SEEN = 200_000  # classes that a task remembers, so as not to index a copy again


class Scheme:
    """How sets whose larger one has up to ``top`` shingles are cut; percent: the similarity."""

    def __init__(self, band: int, percent: int):
        self.band, self.top = band, int(EDGES[band + 1] - 1)
        self.bound = (100 - percent) * 2 * self.top // (100 + percent)
        self.deletion = self.bound == 1
        self.segments = 1 if self.deletion else self.bound + 1 + 3 + self.bound // 4
        self.salt = mix64(np.array([0x5851F42D4C957F2D + band], np.uint64))[0]

    def keys(self, sets: np.ndarray) -> tuple[np.ndarray, int]:
        """Keys of a set (sorted distinct hashes) and how many of them a query may skip."""
        if self.bound == 0:
            return np.zeros(0, np.uint64), 0
        x = mix64(sets ^ self.salt)
        if self.deletion:
            whole = x.sum(dtype=np.uint64)
            return mix64(np.concatenate([[whole], whole - x]) + self.salt), 0
        at = ((x >> U(32)) * U(self.segments)) >> U(32)
        order = np.argsort(at, kind="stable")
        own = at[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums = np.add.reduceat(mix64(x[order]), first)
        keys = mix64(sums + mix64(own[first] + self.salt))
        if len(keys) < self.bound + 1:
            # More empty segments than may be skipped; sets that agree on these alone have as many.
            empty = np.setdiff1d(np.arange(self.segments, dtype=np.uint64), own)
            keys = np.concatenate([keys, mix64(mix64(empty + self.salt))])
        return keys, len(keys) - self.bound - 1


def schemes_of(n: int, percent: int, made: dict[int, Scheme]) -> list[Scheme]:
    """The schemes under which a set of n shingles is indexed: of its band, and of the next if a similar set can be there."""
    band = int(np.searchsorted(EDGES, n, side="right")) - 1
    bands = [band] + ([band + 1] if 100 * n >= percent * int(EDGES[band + 1]) else [])
    return [made.setdefault(b, Scheme(b, percent)) for b in bands]


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each value's shingles; fewer words than ``width`` make one shingle."""
    data, offsets = column_bytes(column)
    h, _, _, starts = words_of(LOWER[data], offsets)
    gram = mix64(grams(h, width)) if len(h) >= width else np.zeros(0, np.uint64)
    out = []
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(np.unique(gram[a : z - width + 1]))
        elif z > a:
            out.append(mix64(spans_hash(h, np.array([a]), np.array([z])) + U(z - a)))
        else:
            out.append(gram[:0])
    return out


def class_of(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """Two numbers that equal sets share; sums don't depend on order. The first one depends on the salt, the second does not."""
    one, two = (mix64(x).sum(keepdims=True, dtype=np.uint64) for x in (s ^ U(0x2545F4914F6CDD1D), s + U(0x632BE59BD9B4E019)))
    made = mix64(one * U(0x9E3779B97F4A7C15) + two + U(len(s)) + mix64(np.array([salt], np.uint64)))
    return int(as_long(made)[0]), int(as_long(mix64(one ^ mix64(two)))[0])


LANES = 8
DRAWN = 4


def sketch_of(s: np.ndarray) -> np.ndarray:
    """64 * LANES parities of the set's hashes. Sketches of two sets differ in at most as many bits as the sets differ in shingles."""
    at = (mix64(s + U(0x8CB92BA72F3D8DD7)) >> U(32)).astype(np.int64) % (64 * LANES)
    return np.packbits((np.bincount(at, minlength=64 * LANES) & 1).astype(np.uint8)).view(np.int64)


def wide_sketch_of(s: np.ndarray) -> np.ndarray | None:
    """As sketch_of, as many parities as a large set has shingles (a power of two); None for small sets, which sketch_of serves well."""
    if len(s) <= 48 * LANES:
        return None
    size = 1 << max(9, (len(s) - 1).bit_length())
    at = (mix64(s + U(0x8CB92BA72F3D8DD7)) >> U(32)).astype(np.int64) & (size - 1)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).view(np.int64)


def class_rows(keyed: DataFrame, width: int, salt: int) -> DataFrame:
    """KEY, doc_id, n, class, twin and sketches of every row."""
    names = ["doc", "tag", "mark", "doc_id", "n", "class", "twin", *(f"s{k}" for k in range(LANES))]

    def rows(batches):
        for b in slices(batches, 4, 1 << 18):
            sets = shingle_sets(b.column(4), width)
            lanes = np.array([sketch_of(s) for s in sets]).reshape(-1, LANES).T
            classes = np.array([class_of(s, salt) for s in sets], np.int64).reshape(-1, 2).T
            yield pa.record_batch([*(b.column(k) for k in range(4)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in (*classes, *lanes)), pa.array([wide_sketch_of(s) for s in sets], pa.list_(pa.int64()))], [*names, "wide"])

    return keyed.select(*KEY, "doc_id", "text").mapInArrow(rows, ", ".join(f"{x} long" for x in names) + ", wide array<long>")


KEYS = "key long, class long, n int, spare int, band int"


def key_rows(keyed: DataFrame, width: int, percent: int, salt: int) -> DataFrame:
    """A row per key of every class; copies in one task are indexed once."""

    def rows(batches):
        seen, made = set(), {}
        for b in slices(batches, 0, 1 << 18):
            out = []
            for s in shingle_sets(b.column(0), width):
                if not len(s):
                    continue
                c = class_of(s, salt)[0]
                if c in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                for scheme in schemes_of(len(s), percent, made):
                    keys, spare = scheme.keys(s)
                    out.append((keys, np.array([c, len(s), spare, scheme.band], np.int64)))
            if out:
                count = [len(k) for k, _ in out]
                rest = np.repeat(np.array([x for _, x in out]), count, axis=0)
                yield pa.record_batch([pa.array(as_long(np.concatenate([k for k, _ in out]))), pa.array(np.ascontiguousarray(rest[:, 0])), *[pa.array(rest[:, k].astype(np.int32)) for k in (1, 2, 3)]], ["key", "class", "n", "spare", "band"])

    return keyed.select("text").mapInArrow(rows, KEYS)


def verified(keyed: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets, made again from a text of each class, reach the similarity.

    Both texts of a pair meet by its numbers; sorted, pairs with one ``a`` follow each other, so that its set is made once.
    """
    sides = F.array(F.struct(F.col("a").alias("class"), F.lit(0).alias("side")), F.struct(F.col("b").alias("class"), F.lit(1).alias("side")))
    wanted = pairs.select("a", "b", F.explode(sides).alias("s")).select("a", "b", "s.*").join(classes.select("class", *KEY), "class")
    texts = keyed.select(*KEY, "text").join(wanted.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)
    met = wanted.join(texts, KEY).select("a", "b", "side", "text")

    def rows(batches):
        last, one, half = None, None, None
        for b in slices(batches, 3, 1 << 20):
            good: list[tuple[int, int]] = []
            a, z, side = (b.column(k).to_pylist() for k in range(3))
            # Sets of the second texts, and of the first of those that differ from the one before.
            need = [k for k in range(len(a)) if side[k] or a[k] != (a[k - 2] if k > 1 else last)]
            sets = dict(zip(need, shingle_sets(b.column(3).take(pa.array(need, pa.int64())), width), strict=True))
            for k in range(len(a)):
                if not side[k]:
                    if k in sets and a[k] != last:
                        last, one = a[k], sets[k]
                    half = a[k], z[k]
                else:
                    assert half == (a[k], z[k])
                    x, y = one, sets[k]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        good.append(half)
            cols = [list(c) for c in zip(*good, strict=True)] or [[], []]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return met.repartition("a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(rows, "a long, b long")


def near(percent: int):
    """Whether columns n, s0, ... and m, t0, ... allow the similarity: by size, and by the bits in which the sketches differ."""
    apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(LANES)), F.lit(0))
    sizes = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    room = (F.col("n") + F.col("m")) * (100 - percent)
    # Wide sketches have a power of two of parities; the longer one is folded to the shorter.
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
    bits = F.aggregate(F.zip_with(fold("wide", "broad"), fold("broad", "wide"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    unlike = F.col("wide").isNotNull() & F.col("broad").isNotNull() & (bits * (100 + percent) > room)
    return sizes & (apart * (100 + percent) <= room) & ~unlike


def class_links(keyed: DataFrame, classes: DataFrame, width: int, percent: int, salt: int) -> DataFrame:
    """(class, component) of all classes that are linked to another one. classes: class, KEY of a row, n and sketch, a row per class."""
    keys = key_rows(keyed, width, percent, salt)
    again = keys.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo <> hi").select("key", "c", F.col("lo").alias("pivot"))
    again = staged(again, "repeated-keys")
    shared = keys.join(again, "key").select("key", "class", "spare", "band", "c", "pivot").distinct()
    by = Window.partitionBy("class", "band").orderBy(F.col("c").desc(), "key")
    shared = staged(shared.withColumn("query", F.row_number().over(by) > F.col("spare")).select("key", "class", "pivot", "query"), "shared-keys")
    discard(again)

    sketches = [f"s{k}" for k in range(LANES)]
    one = classes.select("class", "n", "wide", *sketches)
    two = classes.select(F.col("class").alias("other"), F.col("n").alias("m"), F.col("wide").alias("broad"), *(F.col(f"s{k}").alias(f"t{k}") for k in range(LANES)))
    pair = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    # First against the smallest class of a key, the one that most keys are shared with; then against the rest of these.
    star = shared.filter("class <> pivot").groupBy("class", F.col("pivot").alias("other")).agg(F.count(F.lit(1)).alias("c"))
    star = star.join(two, "other").join(one, "class").filter(near(percent)).select("class", "other", "c")
    star = staged(star.withColumn("best", F.row_number().over(Window.partitionBy("class").orderBy(F.col("c").desc(), "other")) == 1), "stars")

    def check(pairs: DataFrame) -> DataFrame:
        return staged(verified(keyed, classes, pairs, width, percent), "links")

    def label(df: DataFrame, name: str, to: str) -> DataFrame:
        own = found.select(F.col("id").alias(name), F.col("component").alias("__c"))
        return df.join(own, name, "left").withColumn(to, F.coalesce("__c", name)).drop("__c")

    links = check(pair(star.filter("best"), "class", "other").distinct())
    found = staged(components(links), "components")
    apart = staged(pair(label(label(star.filter("not best"), "class", "p"), "other", "q").filter("p <> q"), "class", "other").distinct(), "pairs")
    if not apart.isEmpty():
        links = links.unionByName(check(apart))
        found = staged(components(links), "components")

    # Keys whose classes are in several components still: against some more classes of the key, drawn by hash.
    tested = pair(star, "class", "other")
    labelled = staged(label(shared.select("key", "class", "query"), "class", "p"), "labelled")
    draw = F.array(*[F.min(F.struct(F.xxhash64("class", F.lit(k)).alias("h"), F.col("class").alias("other"), F.col("p").alias("q"))) for k in range(DRAWN)])
    some = staged(labelled.groupBy("key").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), draw.alias("drawn")).filter("lo <> hi").select("key", "drawn"), "drawn")
    met = labelled.join(some, "key").select("class", "p", F.explode("drawn").alias("d")).filter("p <> d.q").select("class", "d.other").distinct()
    met = met.join(two, "other").join(one, "class").filter(near(percent))
    met = staged(pair(met, "class", "other").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    if not met.isEmpty():
        links, tested = links.unionByName(check(met)), tested.unionByName(met)
        found = staged(components(links), "components")

    # The rest: a query against all others of such a key.
    last, labelled = labelled, staged(label(labelled.select("key", "class", "query"), "class", "p"), "labelled")
    discard(last, shared, some)
    several = staged(labelled.groupBy("key").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.max("query").alias("any")).filter("lo <> hi AND any").select("key"), "several")
    left = labelled.join(several, "key", "left_semi")
    q = left.filter("query").select("key", "class", F.col("p").alias("p1")).join(one, "class")
    # A pair that both would query meets once.
    others = left.select("key", F.col("class").alias("other"), F.col("p").alias("p2"), F.col("query").alias("q2")).join(two, "other")
    rest = q.join(others, (q["key"] == left["key"]) & F.expr("p1 <> p2 AND (NOT q2 OR class < other)") & near(percent))
    rest = staged(pair(rest, "class", "other").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        found = staged(components(links.unionByName(check(rest))), "components")
    discard(labelled, several)
    return found.select(F.col("id").alias("class"), "component")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """KEY, doc_id, n and component (a class; null without shingles) of every row of docs; a written table.

    Classes are numbers of 64 bits, held against a second one: if two different sets had one number,
    all would be numbered anew with the next salt.
    """
    keyed = with_key(docs)
    lanes = [F.first(f"s{k}").alias(f"s{k}") for k in range(LANES)] + [F.first("wide").alias("wide")]
    for salt in range(1 << 16):
        info = staged(class_rows(keyed, width, salt), "classes")
        classes = info.filter("n > 0").groupBy("class").agg(F.min(F.struct(*KEY)).alias("one"), F.first("n").alias("n"), F.min("twin").alias("lo"), F.max("twin").alias("hi"), *lanes)
        classes = staged(classes.select("class", "one.*", "n", "lo", "hi", "wide", *(f"s{k}" for k in range(LANES))), "distinct-classes")
        if classes.filter("lo <> hi").isEmpty():
            break
    found = class_links(keyed, classes, width, percent, salt)
    forget(docs.sparkSession)
    out = info.select(*KEY, "doc_id", "n", "class").join(found, "class", "left")
    return staged(out.select(*KEY, "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "class")).alias("component")), "groups")


def join_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text; other columns are ignored).

    Linked are texts whose shingle sets have an intersection of at least ``percent`` hundredths of their
    union. Null, empty and blank texts have no shingles and are their own components; repeated rows
    have equal results; a null doc_id counts as smaller than all others and is given back as null. An
    empty table gives an empty one. A text is held whole by the task that cuts its shingles (2 GB at most).
    """
    lean(docs.sparkSession)
    rows = grouped(docs, width, percent)
    low = rows.filter("n > 0").groupBy("component").agg(F.when(F.max(F.col("doc_id").isNull()), F.lit(None)).otherwise(F.min("doc_id")).alias("low"))
    low_id = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id"))
    return rows.join(low, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), low_id.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of every group of linked rows of docs the one with the smallest doc_id (ids go before none), all columns.

    Rows of one doc_id are ordered by hashes of their texts; of rows equal in doc_id and text one
    stays. Rows without words are linked with nothing.
    """
    lean(docs.sparkSession)
    rows = grouped(docs, width, percent)
    best = rows.filter("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *KEY)).alias("best"))
    kept = best.select(*[F.col(f"best.{c}") for c in KEY]).unionByName(rows.filter("n = 0").select(*KEY).distinct())
    carried = [f"carried_{k}" for k in range(len(docs.columns))]
    found = with_key(docs, *docs.columns).dropDuplicates(KEY).join(kept, KEY, "left_semi")
    return found.select(*[F.col(n).alias(c) for n, c in zip(carried, docs.columns, strict=True)])


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"), width=4, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[k : k + 3], ' ') END AS sh
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS k FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.id
), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id
"""
