"""Column expressions for text, numbers and hashes; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def half_up(x: Column) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def finite(x: Column) -> Column:
    """NaN and infinities become null, minus zero becomes zero."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x + F.lit(0.0))


def _let(value: Column, then) -> Column:
    """then(value) with value computed once; evaluated outside generated code, for what is rarely needed."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _without_exponent(s: Column, least: int = -6, most: int = 21, width: int = 1) -> Column:
    """The text of a double with an exponent (1.25E-5) as plain decimals between 1e-6 and 1e21, or other powers of ten; exponents have ``width`` digits at least."""

    def parts(v: Column) -> Column:
        digits, power = v["digits"], v["power"]
        whole = F.concat(F.substring(F.rpad(digits, 400, "0"), F.lit(1), power + 1), F.when(F.length(digits) > power + 1, F.concat(F.lit("."), F.substring(digits, power + 2, F.lit(400)))).otherwise(""))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        mantissa = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(""))
        size = F.abs(power).cast("string")
        long = F.concat(mantissa, F.lit("e"), F.when(power > 0, "+").otherwise("-"), F.repeat(F.lit("0"), F.lit(width) - F.length(size)), size)
        return F.concat(v["sign"], F.when((power >= 0) & (power < most), whole).when((power < 0) & (power >= least), small).otherwise(long))

    def split(t: Column) -> Column:
        digits = F.replace(F.regexp_replace(F.regexp_extract(t, r"^-?([0-9.]+)E", 1), r"\.0$", ""), F.lit("."), F.lit(""))
        power = F.coalesce(F.regexp_extract(t, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        return F.struct(digits.alias("digits"), power.alias("power"), F.when(t.startswith("-"), "-").otherwise("").alias("sign"))

    return _let(s, lambda t: F.when(F.contains(t, F.lit("E")), _let(split(t), parts)).otherwise(F.regexp_replace(t, r"\.0$", "")))


def plain_double(x: Column) -> Column:
    """A finite double in decimal notation without a needless fraction; exponents only beyond 1e21 and below 1e-6.

    Whole numbers and those whose text has no exponent take the short ways.
    """
    y = x + F.lit(0.0)
    size = F.abs(x)
    return F.when((size < 1e15) & (x % 1 == 0), y.cast("long").cast("string")).when((size >= 1e-3) & (size < 1e7), y.cast("string")).otherwise(_without_exponent(y.cast("string")))


def sql_double(x: Column) -> Column:
    """A double as DuckDB's VARCHAR has it, without a needless fraction: minus zero keeps its sign, exponents from 1e16 and below 1e-4, nan and inf.

    Digits are Java's; before Java 19 some beyond 1e16 and the smallest ones are not the shortest, as DuckDB's are.
    """
    size, s = F.abs(x), x.cast("string")
    odd = F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(_without_exponent(s, -4, 16, 2))
    return F.when((size > 0) & (size < 1e15) & (x % 1 == 0), x.cast("long").cast("string")).when((size >= 1e-3) & (size < 1e7), s).when(size == 0, F.replace(s, F.lit(".0"), F.lit(""))).otherwise(odd)


def to_text(c: Column, kind: T.DataType) -> Column:
    """The text of a scalar; null stays null. Arrays and structs become JSON, timestamps ISO-8601 in UTC with milliseconds."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        odd = F.when(F.isnan(c), "NaN").when(c > 0, "Infinity").otherwise("-Infinity")
        return F.when(F.abs(c) < float("inf"), plain_double(c.cast("double"))).when(c.isNotNull(), odd)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, T.DecimalType):
        return plain_double(c.cast("double"))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def to_number(text: Column) -> Column:
    """The number that a text stands for: blank is zero, no number is null (and so in no range)."""
    t = F.trim(text)
    hexa = F.conv(F.regexp_extract(t, "^0[xX]([0-9a-fA-F]+)$", 1), 16, 10).try_cast("double")
    return F.when(t == "", 0.0).when(t.rlike(NUMBER), t.try_cast("double")).when(t.rlike("^0[xX][0-9a-fA-F]+$"), hexa)


def csv_cell(text: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line feed; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def markdown_cell(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(F.replace(t, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def compact_text(t: Column) -> Column:
    """Text in a compact cell: tabs and line feeds escaped, a literal @N marked."""
    t = F.replace(F.replace(t, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    return F.when(t.rlike(r"^@[0-9]+$"), F.concat(F.lit("\\"), t)).otherwise(t)


def compact_value(c: Column, kind: T.DataType) -> Column:
    """A value in the compact format: _ for null, T and F, arrays with spaces, objects in braces."""
    if isinstance(kind, T.BooleanType):
        out = F.when(c, "T").otherwise("F")
    elif isinstance(kind, T.StringType):
        out = compact_text(c)
    elif isinstance(kind, T.ArrayType):
        glue = ";" if isinstance(kind.elementType, T.StructType) else " "
        out = F.array_join(F.transform(c, lambda x: compact_value(x, kind.elementType)), glue)
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f.name + ":"), compact_value(c[f.name], f.dataType)) for f in kind]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    else:
        out = to_text(c, kind)
    return F.when(c.isNull(), "_").otherwise(out)


def record_quoted(t: Column) -> Column:
    """Text in a record: quoted and escaped where it could be taken for something else."""
    special = (t == "") | t.rlike(r'[\s"\\|>,={}\[\]@#]') | t.isin("_", "true", "false") | t.rlike(r"^[@#][0-9]+$") | t.rlike(NUMBER)
    e = t
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        e = F.replace(e, F.lit(raw), F.lit(code))
    return F.when(special, F.concat(F.lit('"'), e, F.lit('"'))).otherwise(t)


def record_value(c: Column, kind: T.DataType) -> Column:
    """A scalar in a record; null is _ ."""
    if isinstance(kind, T.BooleanType):
        out = F.when(c, "true").otherwise("false")
    elif isinstance(kind, T.StringType):
        out = record_quoted(c)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.concat(F.lit('"'), to_text(c, kind), F.lit('"'))).otherwise(to_text(c, kind))
    elif isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.TimestampType, T.TimestampNTZType)):
        out = record_quoted(to_text(c, kind))
    else:
        out = to_text(c, kind)
    return F.when(c.isNull(), "_").otherwise(out)


def strip_line_ends(t: Column) -> Column:
    """Without blanks at the ends of lines."""
    return F.regexp_replace(t, r"(?m)[^\S\n]+$", "")


def byte_size(t: Column) -> Column:
    return F.octet_length(t).cast("long")


def token_estimate(t: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(t) / 4).cast("long")


def hash_chain(stages: Column, nonce: Column, tag: str) -> Column:
    """h(i) = sha256(h(i-1), label, tag, data) over an array of (label, data)."""
    return F.aggregate(stages, F.sha2(nonce, 256), lambda h, s: F.sha2(F.concat(h, s["label"], F.lit(tag), s["data"]), 256))


def watermark(fingerprint: Column, size: Column, tag: str) -> Column:
    return F.sha2(F.concat(fingerprint, size.cast("string"), F.lit(tag)), 256)


def fingerprint_similarity(stages_a: Column, stages_b: Column, same_build: Column, score_a: Column, score_b: Column) -> Column:
    """1 for equal stages, else half the share of equal ones, 0.3 for the same build and 0.2 for near scores."""
    n = F.greatest(F.size(stages_a), F.size(stages_b))
    alike = F.size(F.filter(F.zip_with(stages_a, stages_b, lambda x, y: x == y), lambda z: F.coalesce(z, F.lit(False))))
    mixed = F.lit(0.5) * F.coalesce(F.try_divide(alike, n), F.lit(0.0)) + F.when(same_build, 0.3).otherwise(0.0) + F.lit(0.2) * (1 - F.abs(score_a - score_b) / 100)
    return F.when(stages_a == stages_b, 1.0).otherwise(mixed)


def delta_encode(a: Column) -> Column:
    """The first element, then differences."""
    return F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(a, F.greatest(i, F.lit(1)))))


def run_lengths(a: Column, kind: str) -> Column:
    """Runs of equal neighbours as (v, n)."""
    start = F.array().cast(f"array<struct<v:{kind},n:int>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["v"].alias("v"), (last["n"] + 1).alias("n"))))
        new = F.concat(acc, F.array(F.struct(x.cast(kind).alias("v"), F.lit(1).alias("n"))))
        return F.when((F.size(acc) > 0) & last["v"].eqNullSafe(x), grown).otherwise(new)

    return F.aggregate(a, start, step)


def array_plan(a: Column, numeric: bool) -> Column:
    """How an array is best coded: delta if numeric and sorted as text, rle if sorted and repeating, dict if few distinct values."""
    text = F.transform(a, lambda x: x.cast("string"))
    in_order = text == F.array_sort(text)
    distinct = F.size(F.array_distinct(text))
    return F.when((F.size(a) == 0) | a.isNull(), "none").when(F.lit(numeric) & in_order, "delta").when((F.size(a) > distinct * 1.5) & in_order, "rle").when(distinct < F.size(a) * 0.5, "dict").otherwise("none")


def prefix_length(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    n = F.least(F.size(a), F.size(b))
    stop = F.array_position(F.slice(same, 1, F.greatest(n, F.lit(1))), F.lit(False))
    return F.when((n <= 0) | a.isNull() | b.isNull(), 0).when(stop > 0, stop - 1).otherwise(n).cast("int")


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two texts of any length: steps of halving size, each taken if both texts go on alike."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    room = F.least(F.length(a), F.length(b))
    n = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= room) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step)), n + step).otherwise(n))
    return F.substring(a, F.lit(1), n)
