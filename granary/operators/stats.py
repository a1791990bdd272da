"""Statistics over a dataset's cells: entropy, sparsity, structure, complexity, repetition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalar import half_up
from granary.operators.dataset import ORDER, kind_of, leaves, melt, ordered, path


def column_entropy(df: DataFrame, keys: list[str]) -> DataFrame:
    """field, entropy in bits of the distribution of its values, rank by entropy (descending, then name)."""
    counts = melt(df, keys).groupBy("field", "value").agg(F.count(F.lit(1)).alias("c"))
    total = Window.partitionBy("field")
    p = F.col("c") / F.sum("c").over(total)
    e = counts.withColumn("e", -p * F.log2(p)).groupBy("field").agg(F.round(F.sum("e"), 9).alias("entropy"))
    return e.withColumn("rank", F.row_number().over(Window.orderBy(F.col("entropy").desc(), "field")))


def constant_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fields with one and the same value (or null) in all rows."""
    g = melt(df, keys).groupBy("field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("c"), F.count(F.lit(1)).alias("n"))
    return g.filter("(c = n AND lo = hi) OR c = 0").select("field", F.col("lo").alias("value"))


def common_prefixes(df: DataFrame, keys: list[str]) -> DataFrame:
    """field, prefix of texts longer than ten characters: the common prefix of the smallest and the largest."""
    from granary.functions.scalar import common_prefix

    long = melt(df, keys).filter("kind = 'string' AND length(value) > 10")
    g = long.groupBy("field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("texts"))
    return g.select("field", "texts", common_prefix(F.col("lo"), F.col("hi")).alias("prefix"))


def sparsity(df: DataFrame, keys: list[str]) -> DataFrame:
    """cells, empty (null or blank) and their ratio."""
    g = melt(df, keys).agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("value").isNull() | (F.col("value") == ""), 1)).alias("empty"))
    return g.withColumn("ratio", F.round(F.coalesce(F.try_divide("empty", "cells"), F.lit(0.0)), 9))


def structure(docs: DataFrame, doc: str) -> DataFrame:
    """Profile of a table of JSON objects by the keys that are present: one row.

    repetition_ratio_ref is 1 / rows wherever there are values; repetition_ratio is distinct over all values.
    """
    cells = docs.select(F.explode_outer(F.json_object_keys(doc)).alias("path"), F.col(doc).alias("d"))
    cells = cells.withColumn("value", F.expr("try_variant_get(try_parse_json(d), concat('$.', path), 'string')"))
    rows = docs.agg(F.count(F.lit(1)).alias("rows"))
    per = cells.filter("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("kinds"), F.count("value").alias("vals"))
    depth = docs.agg(F.max(F.size(F.json_object_keys(doc))).alias("most_fields"))
    g = per.crossJoin(F.broadcast(rows)).groupBy("rows").agg(
        F.count(F.lit(1)).alias("fields"),
        F.sum(F.when(F.col("n") == F.col("rows"), 1).otherwise(0)).alias("always"),
        F.sum("n").alias("present"),
        F.sum("kinds").alias("kinds"),
        F.sum("vals").alias("vals"),
    )
    g = g.crossJoin(F.broadcast(depth))
    return g.select(
        "rows",
        "fields",
        F.round(F.col("always") / F.col("fields") * 100, 6).alias("consistency_pct"),
        F.round((F.col("fields") - F.col("always")) / F.col("fields") * 100, 6).alias("optional_pct"),
        F.round(F.col("present") / F.col("rows"), 6).alias("fields_per_row"),
        F.col("most_fields").cast("long").alias("most_fields"),
        F.round(F.lit(1.0) / F.col("rows"), 9).alias("repetition_ratio_ref"),
        F.round(F.coalesce(F.try_divide("kinds", "vals"), F.lit(1.0)), 6).alias("repetition_ratio"),
    )


def benefit_score(rows: Column, consistency: Column, optional: Column, ratio: Column, depth: Column) -> Column:
    """0 to 100: how much a structured format is expected to save."""
    return F.least(
        F.lit(100.0),
        F.least(F.lit(30.0), consistency * 0.3)
        + F.when(ratio < 0.5, 25).when(ratio < 0.7, 15).when(ratio < 0.9, 5).otherwise(0)
        + F.when(rows > 1000, 20).when(rows > 100, 15).when(rows > 10, 5).otherwise(0)
        + F.when(optional < 10, 15).when(optional < 30, 10).otherwise(0)
        + F.when(depth <= 2, 10).when(depth <= 4, 5).otherwise(0),
    )


def strategy(score: Column, consistency: Column, ratio: Column, depth: Column, rows: Column) -> Column:
    """The recommended format."""
    return (
        F.when((score >= 60) & (consistency >= 80), "token_binary")
        .when((score >= 50) & (ratio < 0.5), "token_binary")
        .when(depth > 4, "markdown")
        .when(consistency < 50, F.when(score >= 40, "token_binary").otherwise("csv"))
        .when(rows < 5, "json")
        .when(score >= 25, "token_binary")
        .otherwise("csv")
    )


def nesting(schema: T.DataType) -> int:
    """Levels of structs and arrays; a scalar has none."""
    if isinstance(schema, T.StructType):
        return 1 + max((nesting(f.dataType) for f in schema), default=0)
    if isinstance(schema, T.ArrayType):
        return 1 + nesting(schema.elementType)
    return 0


def _array_levels(values: Column, kind: T.DataType, depth: int) -> list[tuple[int, Column, Column]]:
    """Depth, number and total length of the arrays at every level below a list of values of this kind."""
    if isinstance(kind, T.ArrayType):
        some = F.filter(values, lambda x: x.isNotNull())
        own = depth + 1, F.size(some), F.aggregate(some, F.lit(0), lambda a, x: a + F.size(x))
        return [own, *_array_levels(F.flatten(some), kind.elementType, depth + 1)]
    if isinstance(kind, T.StructType):
        return [m for f in kind for m in _array_levels(F.transform(values, lambda x: x[f.name]), f.dataType, depth)]  # noqa: B023
    return []


def complexity(df: DataFrame, keys: list[str], shape: Column | None = None) -> DataFrame:
    """Field entropy, depth, polymorphism, type cardinality, array complexity and sparsity, as one score of 0 to 100 and a class.

    Entropy is that of the paths over all rows; array complexity is the mean depth of arrays times their mean length.

    shape: the key set of a row where rows differ; by default all rows have the columns.
    """
    data = df.drop(*keys)
    own = leaves(data.schema)
    n = len(own)
    depth = nesting(data.schema)
    kinds = len({kind_of(k) for _, k in own} | ({"object"} if depth > 1 else set()))
    parts = [(name, [name.rsplit(".", j)[0] for j in range(name.count("."), 0, -1)]) for name, _ in own]
    # Where a struct is missing, its own path takes the place of its leaves.
    inner = {s: ps[:k] for _, ps in parts for k, s in enumerate(ps)}
    there = lambda ps: [path(x).isNotNull() for x in ps]
    cases = [there(ps) for _, ps in parts] + [[*there(ps), path(x).isNull()] for x, ps in inner.items()]
    counts = [F.count(F.when(reduce(lambda a, b: a & b, case, F.lit(True)), 1)).alias(f"__c{k}") for k, case in enumerate(cases)]
    levels = [m for f in data.schema for m in _array_levels(F.array(F.col(f"`{f.name}`")), f.dataType, 0)]
    arrays = [x for k, (_, n_, size) in enumerate(levels) for x in (F.sum(n_).alias(f"__n{k}"), F.sum(size).alias(f"__s{k}"))]
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(sum((F.when(path(p).isNull(), 1).otherwise(0) for p, _ in own), F.lit(0))).alias("empty"), (F.countDistinct(shape) if shape is not None else F.lit(1)).alias("shapes")]
    g = df.agg(*aggs, *counts, *arrays)
    rows = F.greatest(F.col("rows"), F.lit(1))
    each = [F.col(f"__c{k}") for k in range(len(cases))]
    total = F.greatest(sum(each, F.lit(0)), F.lit(1))
    entropy = sum((F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in each), F.lit(0.0))
    poly = F.least(F.lit(1.0), F.col("shapes") / rows)
    found = sum((F.coalesce(F.col(f"__n{k}"), F.lit(0)) for k in range(len(levels))), F.lit(0))
    depths = sum((F.coalesce(F.col(f"__n{k}"), F.lit(0)) * d for k, (d, _, _) in enumerate(levels)), F.lit(0))
    lengths = sum((F.coalesce(F.col(f"__s{k}"), F.lit(0)) for k in range(len(levels))), F.lit(0))
    array = F.coalesce(F.try_divide(depths, found) * F.try_divide(lengths, found), F.lit(0.0))
    sparse = F.coalesce(F.col("empty"), F.lit(0)) / (rows * max(n, 1))
    points = F.least(F.lit(25.0), entropy / 5 * 25) + min(20.0, depth / 6 * 20) + F.least(F.lit(15.0), poly * 15) + min(15.0, kinds / 7 * 15) + F.least(F.lit(15.0), array / 10 * 15) + F.least(F.lit(10.0), sparse * 20)
    score = F.greatest(F.lit(0), F.least(F.lit(100), half_up(points))).cast("int")
    out = g.select("rows", F.round(entropy, 6).alias("entropy"), F.lit(depth).alias("depth"), F.round(poly, 9).alias("polymorphism"), F.lit(kinds).alias("kinds"), F.round(array, 6).alias("array_complexity"), F.round(sparse, 9).alias("sparsity"), score.alias("score"))
    return out.withColumn("class", F.when(F.col("score") >= 80, "extreme").when(F.col("score") >= 60, "complex").when(F.col("score") >= 40, "moderate").when(F.col("score") >= 20, "simple").otherwise("trivial"))


def repetition(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct and all texts, their reuse, mean length and entropy."""
    texts = melt(df.select(*keys, *[c for c, t in df.dtypes if t in ("string", "array<string>") and c not in keys]), keys, explode_arrays=True).filter("value is not null")
    counts = texts.groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    g = counts.crossJoin(F.broadcast(total)).agg(F.count(F.lit(1)).alias("distinct_texts"), F.max("n").alias("texts"), F.sum(F.col("c") * F.length("value")).alias("chars"), F.sum(-p * F.log2(p)).alias("e"))
    return g.select("distinct_texts", "texts", F.round(1 - F.col("distinct_texts") / F.col("texts"), 9).alias("reuse"), F.round(F.col("chars") / F.col("texts"), 6).alias("mean_length"), F.round("e", 6).alias("entropy"))


def shape_consistency(docs: DataFrame, doc: str, order: str) -> DataFrame:
    """Mean Jaccard similarity of each row's keys with those of the first row."""
    keys = docs.select(order, F.json_object_keys(doc).alias("k"))
    first = keys.agg(F.min_by("k", order).alias("k0"))
    j = F.size(F.array_intersect("k", "k0")) / F.size(F.array_union("k", "k0"))
    return keys.crossJoin(F.broadcast(first)).agg(F.round(F.avg(j), 9).alias("consistency"))


def top_candidates(df: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """value, uses of the values that take most characters in all; ties by their first row."""
    g = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("uses"), F.min(order).alias("__first"))
    return g.orderBy((F.col("uses") * F.length("value")).desc(), "__first").limit(n).select("value", "uses")


def path_overlap(paths: DataFrame, known: DataFrame) -> DataFrame:
    """paths, covered: how many distinct paths (p) there are, and how many of them are known."""
    there = known.select("p", F.lit(1).alias("there")).distinct()
    return paths.select("p").distinct().join(there, "p", "left").agg(F.count(F.lit(1)).alias("paths"), F.count("there").alias("covered"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, avg_, max_, min_ and the median of a column."""
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("avg_"), F.max(value).alias("max_"), F.min(value).alias("min_"), F.median(value).alias("p50"))


def width_sensitivity(df: DataFrame, columns: list[str]) -> DataFrame:
    """width, bytes: the size of comma separated lines of the first 1, 2, ... columns, from one scan."""
    sizes = [F.sum(F.octet_length(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns[:w]]))).alias(str(w)) for w in range(1, len(columns) + 1)]
    each = F.array(*[F.struct(F.lit(w).alias("width"), F.col(str(w)).alias("bytes")) for w in range(1, len(columns) + 1)])
    return df.agg(*sizes).select(F.explode(each).alias("r")).select("r.*")


def string_table(texts: DataFrame, order: list[str]) -> DataFrame:
    """s, id: distinct texts (s) numbered by their first place."""
    first = texts.groupBy("s").agg(F.min(F.struct(*order)).alias("__first"))
    return ordered(first, "__first").select("s", F.col(ORDER).alias("id"))


def entropy_correlation(df: DataFrame, keys: list[str], formats: tuple[str, ...] = ("csv", "tsv", "markdown", "json_min")) -> DataFrame:
    """format, entropy, reuse, tokens, tokens_vs_json: how repetitive the texts are beside what each rendering costs (estimated tokens)."""
    from granary.operators import render

    base = render.sizes(df, keys, ("json_min",)).select(F.col("tokens").alias("json"))
    one = repetition(df, keys).select("entropy", "reuse")
    return render.sizes(df, keys, formats).crossJoin(base).crossJoin(one).select("format", "entropy", "reuse", "tokens", F.round(F.coalesce(F.try_divide("tokens", "json"), F.lit(0.0)), 4).alias("tokens_vs_json"))
