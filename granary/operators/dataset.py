"""Datasets: a DataFrame with an order, flattened, melted into cells, and changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalar import compact_value, to_text

ORDER = "_ord"
DEEPEST = 50


def ordered(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows numbered by keys from 0. A range partitioned sort and counts per partition; no single task sees all rows.

    The sorted rows are checkpointed (persisted where no checkpoint folder is set), as the ranges come
    from a sample: counts and rows must be of one and the same sort.
    """
    by = [F.col(k) if isinstance(k, str) else k for k in keys]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_r", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = placed.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else placed.persist()
    counts = placed.groupBy("_p").agg((F.max("_r") + 1).alias("n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    # One row per partition is broadcast.
    return placed.join(F.broadcast(before), "_p").withColumn(ORDER, F.col("_b") + F.col("_r")).drop("_m", "_p", "_r", "_b")


def leaves(schema: T.StructType, prefix: str = "", depth: int = 0) -> list[tuple[str, T.DataType]]:
    """Dotted names and types of all leaves; arrays are leaves, empty structs have none."""
    if depth > DEEPEST:
        raise ValueError("nested too deeply")
    out = []
    for f in schema:
        name = f"{prefix}.{f.name}" if prefix else f.name
        out += leaves(f.dataType, name, depth + 1) if isinstance(f.dataType, T.StructType) else [(name, f.dataType)]
    return out


def path(name: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in name.split(".")))


def flatten(df: DataFrame) -> DataFrame:
    """Structs as columns with dotted names."""
    return df.select(*[path(n).alias(n) for n, _ in leaves(df.schema)])


def unflatten(df: DataFrame) -> DataFrame:
    """Columns with dotted names as structs, in the order of their first column."""

    def build(names: list[tuple[list[str], str]]) -> list[Column]:
        groups: dict[str, list] = {}
        for parts, full in names:
            groups.setdefault(parts[0], []).append((parts[1:], full))
        out = []
        for head, inner in groups.items():
            if len(inner) == 1 and not inner[0][0]:
                out.append(F.col(f"`{inner[0][1]}`").alias(head))
            else:
                out.append(F.struct(*build([x for x in inner if x[0]])).alias(head))
        return out

    return df.select(*build([(c.split("."), c) for c in df.columns]))


def compact_flatten(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """As flatten, and arrays of structs as text: values with spaces, elements with bars. Order columns stay in front."""
    out = [F.col(c) for c in order]
    for name, kind in leaves(df.drop(*order).schema):
        c = path(name)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            fields = kind.elementType
            c = F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[compact_value(x[f.name], f.dataType) for f in fields])), "|")  # noqa: B023
        out.append(c.alias(name))
    return df.select(*out)


def melt(df: DataFrame, keys: Sequence[str], explode_arrays: bool = False) -> DataFrame:
    """Cells: keys, field_idx, field, kind, value (text; null stays null). One pass over the rows."""
    cells = []
    for k, (name, kind) in enumerate(leaves(df.drop(*keys).schema)):
        if explode_arrays and isinstance(kind, T.ArrayType):
            value = F.transform(path(name), lambda x: to_text(x, kind.elementType))  # noqa: B023
        else:
            value = F.array(to_text(path(name), kind))
        cells.append(F.struct(F.lit(k).alias("field_idx"), F.lit(name).alias("field"), F.lit(kind_of(kind)).alias("kind"), value.alias("values")))
    out = df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.field_idx", "c.field", "c.kind", F.explode_outer("c.values").alias("value"))
    return out


def kind_of(kind: T.DataType) -> str:
    """string, number, boolean, null, array or object."""
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NullType):
        return "null"
    return "number" if isinstance(kind, T.NumericType) else "string"


def sorted_keys(kind: T.DataType, c: Column) -> Column:
    """A value whose structs have their fields sorted by name, at every depth."""
    if isinstance(kind, T.StructType):
        made = F.struct(*[sorted_keys(kind[n].dataType, c[n]).alias(n) for n in sorted(kind.names)])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_keys(kind.elementType, x))
    return c


def sort_keys(df: DataFrame) -> DataFrame:
    return df.select(*[sorted_keys(df.schema[n].dataType, F.col(f"`{n}`")).alias(n) for n in sorted(df.columns)])


def row_shapes(df: DataFrame, doc: str, order: str) -> DataFrame:
    """Distinct sorted key lists of JSON objects: shape_id in the order in which they come first, fields, rows."""
    fields = F.array_sort(F.json_object_keys(F.col(doc)))
    g = df.groupBy(fields.alias("fields")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    return g.withColumn("shape_id", F.row_number().over(Window.orderBy("first")) - 1).select("shape_id", "fields", "first", "rows")


def short_names(names: list[str]) -> dict[str, str]:
    """The shortest prefix of each name that no other name has; a name that others extend by an underscore stays whole."""
    out: dict[str, str] = {}
    for n in names:
        others = [m for m in names if m != n]
        if any(m.startswith(n + "_") for m in others):
            out[n] = n
            continue
        out[n] = next((n[:k] for k in range(1, len(n)) if not any(m.startswith(n[:k]) for m in others)), n)
    taken: set[str] = set()
    for n in names:
        if out[n] in taken:
            out[n] = n
        taken.add(out[n])
    return out


def rename_short(df: DataFrame) -> DataFrame:
    short = short_names(df.columns)
    return df.toDF(*[short[c] for c in df.columns])


def row_anchor(df: DataFrame) -> Column:
    """The first of id, number, url, node_id and title that is there, with its name."""
    found = [F.concat(F.lit(f"{c}:"), to_text(F.col(c), df.schema[c].dataType)) for c in ("id", "number", "url", "node_id", "title") if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def mutated(df: DataFrame, order: str, how: str, n: int, change: dict[str, Column] | None = None) -> DataFrame:
    """A dataset with rows 0 .. n-1 by ``order`` after a change: append, prepend, insert, update, delete, shuffle or single_field."""
    first = df.filter(F.col(order) == 0).withColumns(change or {})
    middle = n // 2
    if how == "append":
        return df.unionByName(first.withColumn(order, F.lit(n).cast(df.schema[order].dataType)))
    if how == "prepend":
        return first.unionByName(df.withColumn(order, F.col(order) + 1))
    if how == "insert":
        moved = df.withColumn(order, F.col(order) + F.when(F.col(order) >= middle, 1).otherwise(0))
        return moved.unionByName(first.withColumn(order, F.lit(middle).cast(moved.schema[order].dataType)))
    if how == "update":
        return df.withColumns({c: F.when(F.col(order) == middle, v).otherwise(F.col(c)) for c, v in (change or {}).items()})
    if how == "delete":
        return df.filter(F.col(order) != middle).withColumn(order, F.col(order) - F.when(F.col(order) > middle, 1).otherwise(0))
    if how == "shuffle":
        drawn = ordered(df.withColumn("_draw", F.md5(F.col(order).cast("string"))), "_draw", order)
        return drawn.withColumn(order, F.col(ORDER).cast(df.schema[order].dataType)).select(*df.columns)
    if how == "single_field":
        return df.withColumns(change or {})
    raise ValueError(f"unknown change: {how}")
