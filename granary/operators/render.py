"""Rendering: a dataset becomes lines of text, by one expression per row and, where a format needs
statistics of the whole dataset, one aggregation before.

Lines have a position (part, then the dataset's order): part 0 is the preamble, part 1 the rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import UnknownFormatError
from granary.functions import scalar as S
from granary.operators.dataset import compact_flatten, leaves, path, short_names

LARGEST_DICTIONARY = 10_000
FORMATS = ("json", "json_min", "csv", "markdown", "tsv", "compact", "record_text")


def cells(df: DataFrame, order: list[str], escape, double=None) -> list[Column]:
    """Texts of all leaves; numbers and booleans need no escaping. double: how doubles are written, if not as by to_text."""
    plain = lambda c: F.coalesce(c, F.lit(""))
    text = lambda n, k: double(path(n)) if double and isinstance(k, T.DoubleType) else S.to_text(path(n), k)
    return [(plain if isinstance(k, (T.NumericType, T.BooleanType)) else escape)(text(n, k)) for n, k in leaves(df.drop(*order).schema)]


def csv_row(df: DataFrame, order: list[str], double=None) -> Column:
    return F.concat_ws(",", *cells(df, order, S.csv_cell, double))


def markdown_row(df: DataFrame, order: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells(df, order, S.markdown_cell)), F.lit(" |"))


def tsv_row(df: DataFrame, order: list[str]) -> Column:
    return F.concat_ws("\t", *cells(df, order, lambda c: F.coalesce(c, F.lit(""))))


def json_row(df: DataFrame, order: list[str]) -> Column:
    names = [c for c in df.columns if c not in order]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})


def _quote_csv(s: str) -> str:
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s


def header(df: DataFrame, order: list[str], fmt: str) -> list[str]:
    names = [n for n, _ in leaves(df.drop(*order).schema)]
    if fmt == "csv":
        return [",".join(map(_quote_csv, names))]
    if fmt == "markdown":
        return ["| " + " | ".join(n.replace("|", "\\|") for n in names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    if fmt == "tsv":
        return ["\t".join(names)]
    return []


# --- compact ---------------------------------------------------------------------------------------


@dataclass
class CompactPlan:
    """What the statistics of a dataset decide about its compact form."""

    names: list[str]
    constants: dict[str, str] = field(default_factory=dict)
    templates: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    active: list[str] = field(default_factory=list)
    prefixes: dict[int, str] = field(default_factory=dict)
    short: list[str] = field(default_factory=list)
    mapping: list[str] = field(default_factory=list)
    sparse: bool = False
    dictionary: list[str] = field(default_factory=list)
    rows: int = 0

    def preamble(self) -> list[str]:
        out = []
        if self.constants:
            out.append("@c\t" + "\t".join(f"{k}={v}" for k, v in self.constants.items()))
        if self.templates:
            out.append("@t\t" + "\t".join(f"{c}={a}{{{src}}}{z}" for c, (src, a, z) in self.templates.items()))
        if self.sparse:
            out.append("@sparse")
        out.append("\t".join(self.short if self.mapping else self.active))
        if self.mapping:
            out.append("@f\t" + "\t".join(self.mapping))
        if self.prefixes:
            by: dict[str, list[int]] = {}
            for k, p in self.prefixes.items():
                by.setdefault(p, []).append(k)
            out.append("@p\t" + "\t".join(",".join(map(str, ks)) + "=" + p for p, ks in by.items()))
        if self.dictionary:
            out.append("@d\t" + "\t".join(self.dictionary))
        return out


def constant_columns(flat: DataFrame, names: list[str]) -> DataFrame:
    """One row: for each column whether all rows have the same compact text, that text, and for texts how many are longer than five."""
    aggs = []
    for n in names:
        v = S.compact_value(F.col(f"`{n}`"), flat.schema[n].dataType)
        aggs += [(F.min(v) == F.max(v)).alias(f"{n}?"), F.min(v).alias(f"{n}=")]
        if isinstance(flat.schema[n].dataType, T.StringType):
            aggs.append(F.count(F.when(F.length(f"`{n}`") > 5, 1)).alias(f"{n}#"))
    return flat.agg(F.count(F.lit(1)).alias("#rows"), *aggs)


def template_aggregates(flat: DataFrame, column: str, source: str) -> list[Column]:
    """Whether long texts of a column are prefix + another column + suffix throughout; aggregates n, chars, matched, min and max of both ends."""
    v, kind = F.col(f"`{column}`"), flat.schema[source].dataType
    raw = F.col(f"`{source}`")
    src = F.when(F.length(raw) >= 2, raw) if isinstance(kind, T.StringType) else S.to_text(raw, kind)
    at = F.coalesce(F.position(src, v), F.lit(0))
    long = F.length(v) > 5
    before, after = F.left(v, at - 1), F.substring(v, at + F.length(src), F.length(v))
    good = long & (at > 0)
    return [F.count(F.when(long, 1)), F.sum(F.when(long, F.length(v) + 1)), F.count(F.when(good, 1)), F.min(F.when(good, before)), F.max(F.when(good, before)), F.min(F.when(good, after)), F.max(F.when(good, after))]


def compact_plan(df: DataFrame, order: list[str]) -> tuple[DataFrame, CompactPlan]:
    """Four aggregations (constants, templates, prefixes and sparsity, dictionary); the driver gets a row of each and the dictionary."""
    flat = compact_flatten(df, order)
    names = [c for c in flat.columns if c not in order]
    kinds = {n: flat.schema[n].dataType for n in names}
    p = CompactPlan(names)
    one = constant_columns(flat, names).first()
    p.rows = one["#rows"]
    if not p.rows:
        return flat, p
    p.constants = {n: one[f"{n}="] for n in names if one[f"{n}?"]}
    varying = [n for n in names if n not in p.constants]

    pairs = [(c, s) for c in varying if isinstance(kinds[c], T.StringType) and one[f"{c}#"] >= 0.7 * p.rows for s in varying if s != c and isinstance(kinds[s], (T.StringType, T.NumericType))]
    if pairs:
        aggs = [a.alias(f"{k}_{j}") for k, (c, s) in enumerate(pairs) for j, a in enumerate(template_aggregates(flat, c, s))]
        got = flat.agg(*aggs).first()
        for k, (c, s) in enumerate(pairs):
            n, chars, matched, a0, a1, z0, z1 = (got[f"{k}_{j}"] for j in range(7))
            if c in p.templates or s in p.templates or n < 0.7 * p.rows or not n or matched < n or a0 != a1 or z0 != z1:
                continue
            if chars + len(c) + 1 > 1.5 * (len(c) + len(s) + len(a0) + len(z0) + 10):
                p.templates[c] = (s, a0, z0)
    p.active = [n for n in varying if n not in p.templates]

    texts = [n for n in p.active if isinstance(kinds[n], T.StringType)]
    aggs = [F.sum(sum((F.when(_empty(n, kinds[n]), 1).otherwise(0) for n in p.active), F.lit(0))).alias("#empty")]
    for n in texts:
        v = F.when(F.length(f"`{n}`") > 10, F.col(f"`{n}`"))
        aggs += [F.count(v).alias(f"{n}#"), F.min(v).alias(f"{n}<"), F.max(v).alias(f"{n}>")]
    got = flat.agg(*aggs).first()
    for k, n in enumerate(p.active):
        if n in texts and got[f"{n}#"] >= 0.6 * p.rows and got[f"{n}#"]:
            lo, hi = got[f"{n}<"], got[f"{n}>"]
            common = next((j for j, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))
            if common > 8 and got[f"{n}#"] * common > 2 * (common + 6 + len(str(k))):
                p.prefixes[k] = lo[:common]
    short = short_names(p.active)
    p.short = [short[n] for n in p.active]
    mapping = [f"{short[n]}={n}" for n in p.active if len(short[n]) < len(n)]
    saved = sum(len(n) - len(short[n]) for n in p.active)
    if mapping and saved > 3 + len("\t".join(mapping)):
        p.mapping = mapping
    p.sparse = bool(p.active) and got["#empty"] / (p.rows * len(p.active)) > 0.5
    p.dictionary = [r.value for r in compact_dictionary(flat, order, p).collect()]
    return flat, p


def _empty(n: str, kind: T.DataType) -> Column:
    c = F.col(f"`{n}`")
    return c.isNull() | (c == "") if isinstance(kind, T.StringType) else c.isNull()


def _stripped(n: str, k: int, p: CompactPlan) -> Column:
    c = F.col(f"`{n}`")
    if k in p.prefixes:
        head = p.prefixes[k]
        return F.when(F.startswith(c, F.lit(head)), F.substring(c, len(head) + 1, 1 << 30)).otherwise(c)
    return c


def compact_dictionary(flat: DataFrame, order: list[str], p: CompactPlan) -> DataFrame:
    """value, uses: texts that pay as dictionary entries, most valuable first, at most 10,000."""
    counted = []
    for k, n in enumerate(p.active):
        kind = flat.schema[n].dataType
        if isinstance(kind, T.BooleanType):
            continue
        own = S.compact_value(F.col(f"`{n}`"), kind)
        v = own
        if k in p.prefixes:
            v = F.when(F.startswith(F.col(f"`{n}`"), F.lit(p.prefixes[k])), _stripped(n, k, p)).otherwise(own)
        v = F.when((F.length(own) > 2) & (F.length(v) > 2), v)
        counted.append(F.struct(F.lit(k).alias("_f"), v.alias("value")))
    if not counted:
        return flat.select(F.lit("").alias("value"), F.lit(0).alias("uses")).limit(0)
    long = flat.select(*order, F.explode(F.array(*counted)).alias("c")).select(*order, "c._f", "c.value").filter("value is not null")
    g = long.groupBy("value").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct(*order, "_f")).alias("first"))
    size = g.agg(F.least(F.count(F.lit(1)), F.lit(LARGEST_DICTIONARY)).alias("size"))
    # One row is broadcast.
    g = g.crossJoin(F.broadcast(size))
    n = F.length("value")
    gain = F.col("uses") * (n - (1 + F.length(F.col("size").cast("string"))))
    keep = F.col("value").rlike(r"^@[0-9]+$") | ((F.col("uses") >= 2) & (gain > n + 1))
    return g.filter(keep).orderBy((F.col("uses") * n).desc(), "first").limit(LARGEST_DICTIONARY).select("value", "uses")


def _coded(n: str, k: int, kind: T.DataType, p: CompactPlan) -> Column | None:
    """The text under which a cell is looked up in the dictionary; booleans and others never are."""
    if isinstance(kind, T.StringType):
        return _stripped(n, k, p)
    return S.to_text(F.col(f"`{n}`"), kind) if isinstance(kind, T.NumericType) else None


def referenced(flat: DataFrame, p: CompactPlan) -> DataFrame:
    """With a column _r0, _r1, ... for each active column: the dictionary's reference to its cell, or null.

    The dictionary has at most 10,000 entries and is broadcast; the joins are hash lookups in one stage.
    """
    if not p.dictionary:
        return flat
    words = flat.sparkSession.createDataFrame([(v, f"@{k}") for k, v in enumerate(p.dictionary)], "_value string, _ref string")
    for k, n in enumerate(p.active):
        text = _coded(n, k, flat.schema[n].dataType, p)
        if text is not None:
            own = words.select(F.col("_value").alias(f"_v{k}"), F.col("_ref").alias(f"_r{k}"))
            flat = flat.join(F.broadcast(own), text == F.col(f"_v{k}"), "left").drop(f"_v{k}")
    return flat


def compact_row(flat: DataFrame, p: CompactPlan) -> Column:
    """The row expression over referenced()."""

    def shown(n: str, k: int) -> Column:
        kind = flat.schema[n].dataType
        c = F.col(f"`{n}`")
        text = _coded(n, k, kind, p)
        if text is None:
            return S.compact_value(c, kind)
        ref = F.col(f"_r{k}") if f"_r{k}" in flat.columns else F.lit(None).cast("string")
        if isinstance(kind, T.StringType):
            return F.when(c.isNull() | (c == ""), "_").otherwise(F.coalesce(ref, S.compact_text(text)))
        return F.when(c.isNull(), "_").otherwise(F.coalesce(ref, text))

    if p.sparse:
        parts = [F.when(~_empty(n, flat.schema[n].dataType), F.concat(F.lit(f"{k}:"), shown(n, k))) for k, n in enumerate(p.active)]
        return F.concat_ws("\t", *parts)
    return F.concat_ws("\t", *[shown(n, k) for k, n in enumerate(p.active)]) if p.active else F.lit("")


# --- record text -----------------------------------------------------------------------------------


def record_types(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: name -> type (str, num, bool; [] for arrays, ? for nulls), in column order. A column of nulls only is str?."""
    out = []
    for f in df.drop(*order).schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        base = "bool" if isinstance(kind, T.BooleanType) else "num" if isinstance(kind, T.NumericType) else "str"
        array = "[]" if isinstance(f.dataType, T.ArrayType) else ""
        nulls, some = F.count(F.when(c.isNull(), 1)), F.count(c)
        out.append(F.when(some == 0, "str?").otherwise(F.concat(F.lit(base + array), F.when(nulls > 0, "?").otherwise(""))).alias(f.name))
    return df.agg(*out)


def record_dictionary(df: DataFrame, order: list[str]) -> DataFrame:
    """value, uses, first: texts that stand at least twice, by uses x length, then as they come first."""
    parts = []
    for k, f in enumerate(df.drop(*order).schema):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            parts.append(F.array(F.struct(F.lit(k).alias("_f"), F.lit(0).alias("_i"), c.alias("value"))))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            parts.append(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(k).alias("_f"), i.alias("_i"), x.alias("value"))))  # noqa: B023
    if not parts:
        return df.select(F.lit("").alias("value"), F.lit(0).cast("long").alias("uses")).limit(0)
    long = df.select(*order, F.explode(F.concat(*parts)).alias("c")).select(*order, "c.*").filter("value is not null")
    g = long.groupBy("value").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct(*order, "_f", "_i")).alias("first")).filter("uses >= 2")
    return g.orderBy((F.col("uses") * F.length("value")).desc(), "first").limit(LARGEST_DICTIONARY).select("value", "uses")


def record_references(candidates: list[tuple[str, int]]) -> list[str]:
    """Entries that pay: longer than their reference, or as long and used three times. The reference's length depends on the entries before."""
    out: list[str] = []
    for value, uses in candidates:
        ref = 1 + len(str(len(out)))
        if len(value) > ref or (len(value) == ref and uses >= 3):
            out.append(value)
    return out


def record_referenced(df: DataFrame, order: list[str], dictionary: list[str]) -> DataFrame:
    """With a column _r_NAME for each text column: the dictionary's reference to it, or null; see referenced()."""
    if not dictionary:
        return df
    words = df.sparkSession.createDataFrame([(v, f"@{k}") for k, v in enumerate(dictionary)], "_value string, _ref string")
    for f in df.drop(*order).schema:
        if isinstance(f.dataType, T.StringType):
            own = words.select(F.col("_value").alias("_v"), F.col("_ref").alias(f"_r_{f.name}"))
            df = df.join(F.broadcast(own), F.col(f"`{f.name}`") == F.col("_v"), "left").drop("_v")
    return df


def record_row(df: DataFrame, order: list[str], name: str, dictionary: list[str], coded: DataFrame | None = None) -> Column:
    """The record of a row of df. Texts are looked up in coded = record_referenced(df); elements of arrays in a literal map."""
    own = set(coded.columns if coded is not None else ())
    arrays = any(isinstance(f.dataType, T.ArrayType) for f in df.schema)
    known = F.create_map(*[F.lit(x) for k, v in enumerate(dictionary) for x in (v, f"@{k}")]) if dictionary and arrays else None

    lines = [F.array(F.lit(name))]
    for f in df.drop(*order).schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            kind = f.dataType.elementType
            shown = (lambda x: F.coalesce(known[x], S.record_value(x, kind))) if known is not None and isinstance(kind, T.StringType) else (lambda x: S.record_value(x, kind))  # noqa: B023
            lines.append(F.transform(F.coalesce(c, F.array().cast(f.dataType)), lambda x: F.concat(F.lit(f"  {f.name} "), shown(x))))  # noqa: B023
        else:
            value = S.record_value(c, f.dataType)
            if f"_r_{f.name}" in own:
                value = F.coalesce(F.col(f"`_r_{f.name}`"), value)
            lines.append(F.array(F.when(c.isNotNull(), F.concat(F.lit(f"  {f.name} "), value)).otherwise(f"  {f.name} _")))
    return F.array_join(F.concat(*lines), "\n")


def _json_quoted(s: str) -> str:
    special = s == "" or any(c.isspace() or c in '"\\|>,={}[]@#' for c in s) or s in ("_", "true", "false")
    return json.dumps(s, ensure_ascii=False) if special else s


# --- all formats -----------------------------------------------------------------------------------


def lines(df: DataFrame, fmt: str, order: list[str], name: str = "data", encoding: str = "o200k_base", double=None) -> DataFrame:
    """The dataset as lines: part, the order columns, line. double: how csv writes doubles, if not as by to_text (see scalar.sql_double)."""
    spark = df.sparkSession
    if fmt == "compact":
        flat, p = compact_plan(df, order)
        top = p.preamble() if p.rows else []
        coded = referenced(flat, p)
        body = coded.select(*order, compact_row(coded, p).alias("line"))
    elif fmt == "record_text":
        types = record_types(df, order).first()
        words = record_references([(r.value, r.uses) for r in record_dictionary(df, order).collect()])
        has = not df.isEmpty()
        top = ["@version 1", f"@encoding {encoding}", f"@schema {name}" + "".join(f" {k}:{v}" for k, v in types.asDict().items())] + ([""] if has else [])
        if words and has:
            top += ["@dict " + " ".join(map(_json_quoted, words)), ""]
        coded = record_referenced(df, order, words)
        body = coded.select(*order, record_row(df, order, name, words, coded).alias("line"))
    elif fmt in ("csv", "markdown", "tsv", "json_min", "json"):
        row = csv_row(df, order, double) if fmt == "csv" else {"markdown": markdown_row, "tsv": tsv_row, "json_min": json_row, "json": json_row}[fmt](df, order)
        top = header(df, order, fmt)
        body = df.select(*order, row.alias("line"))
    else:
        raise UnknownFormatError(fmt)
    body = body.select(F.lit(1).alias("part"), *order, "line")
    if not top:
        return body
    kinds = T.StructType([T.StructField("_k", T.IntegerType()), T.StructField("line", T.StringType())])
    heads = spark.createDataFrame(list(enumerate(top)), kinds)
    cast = [(F.col("_k") if k == 0 and isinstance(df.schema[c].dataType, T.NumericType) else F.lit(None)).cast(df.schema[c].dataType).alias(c) for k, c in enumerate(order)]
    return heads.select(F.lit(0).alias("part"), *cast, "line").unionByName(body)


def document(rendered: DataFrame, order: list[str]) -> DataFrame:
    """All lines as one text; for datasets that fit into a value."""
    parts = F.array_sort(F.collect_list(F.struct("part", *order, "line")))
    return rendered.agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("document"))


def write_lines(rendered: DataFrame, order: list[str], path_: str) -> None:
    """Lines in order into text files, however many there are."""
    rendered.orderBy("part", *order).select("line").write.mode("overwrite").text(path_)


def pretty_json(df: DataFrame, order: list[str]) -> str:
    """The dataset as indented JSON, for small datasets."""
    rows = [json.loads(r.line) for r in df.select(*order, json_row(df, order).alias("line")).orderBy(*order).select("line").collect()]
    return json.dumps(rows, indent=2, ensure_ascii=False)


def sizes(df: DataFrame, order: list[str], formats: tuple[str, ...] = ("json_min", "csv", "markdown", "tsv", "record_text", "compact"), double=None) -> DataFrame:
    """format, bytes, tokens (estimated) of each rendering; double as in lines."""
    out = None
    for fmt in formats:
        one = lines(df, fmt, order, double=double).agg(F.sum(F.octet_length("line") + 1).alias("bytes"), F.sum(F.length("line") + 1).alias("chars"))
        extra = 1 if fmt == "json_min" else -1  # brackets and commas; no line feed after the last line
        one = one.select(F.lit(fmt).alias("format"), (F.coalesce("bytes", F.lit(0)) + extra).cast("long").alias("bytes"), F.ceil((F.coalesce("chars", F.lit(0)) + extra) / 4).cast("long").alias("tokens"))
        out = one if out is None else out.unionByName(one)
    return out
