"""Canonical values and their binary form, which names a value by its SHA-256.

The form: a header, a table of the distinct strings in depth-first order (keys of an object sorted,
each before its value), then the value tree with references into the table.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import DecodingError, ValidationError

# Fixed values of the form.
HEADER = b"TENS" + bytes([2])
NULL, TRUE, FALSE, INT8, INT16, INT32, FLOAT64, STRING, ARRAY, OBJECT = range(10)
LINE_END = re.compile(r"[^\S\n]+$", re.MULTILINE)
DEEPEST = 50


def canonical_text(s: str) -> str:
    return LINE_END.sub("", unicodedata.normalize("NFKC", s))


def canonical(v):
    """Text in NFKC without blanks at line ends, finite numbers, sorted keys."""
    if isinstance(v, str):
        return canonical_text(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if not math.isfinite(v) else v + 0.0
    if isinstance(v, dict):
        return {canonical_text(k): canonical(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    if isinstance(v, (list, tuple)):
        return [canonical(x) for x in v]
    return v


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _strings(v, seen: dict[str, int]) -> None:
    stack = [v]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            seen.setdefault(x, len(seen))
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            for k in reversed(x):
                stack += [x[k], k]


def _tree(v, ids: dict[str, int], out: bytearray) -> None:
    if v is None:
        out.append(NULL)
    elif v is True:
        out.append(TRUE)
    elif v is False:
        out.append(FALSE)
    elif isinstance(v, str):
        out.append(STRING)
        out += varint(ids[v])
    elif isinstance(v, list):
        out.append(ARRAY)
        out += varint(len(v))
        for x in v:
            _tree(x, ids, out)
    elif isinstance(v, dict):
        out.append(OBJECT)
        out += varint(len(v))
        for k, x in v.items():
            out += varint(ids[k])
            _tree(x, ids, out)
    elif float(v).is_integer() and -128 <= v <= 127:
        out += struct.pack("<Bb", INT8, int(v))
    elif float(v).is_integer() and -(2**31) <= v < 2**31:
        out += struct.pack("<Bi", INT32, int(v))
    else:
        out += struct.pack("<Bd", FLOAT64, float(v))


def encode(value) -> bytes:
    v, ids = canonical(value), {}
    _strings(v, ids)
    out = bytearray(HEADER + varint(len(ids)))
    for s in ids:
        b = s.encode("utf-8", "surrogatepass")
        out += varint(len(b)) + b
    _tree(v, ids, out)
    return bytes(out)


def decode(data: bytes):
    """The canonical value of a binary form."""
    at = len(HEADER)
    if data[:at] != HEADER:
        raise DecodingError("an unknown header")

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise DecodingError("the data end in a number")
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise DecodingError("the data end too early")
        at += n
        return data[at - n : at]

    table = [take(number()).decode("utf-8", "surrogatepass") for _ in range(number())]

    def text() -> str:
        k = number()
        if k >= len(table):
            raise DecodingError("a string that is not in the table")
        return table[k]

    def value(depth: int = 0):
        if depth > 4 * DEEPEST:
            raise DecodingError("nested too deeply")
        tag = take(1)[0]
        if tag in (NULL, TRUE, FALSE):
            return (None, True, False)[tag]
        if tag == INT8:
            return struct.unpack("<b", take(1))[0]
        if tag == INT16:
            return struct.unpack("<h", take(2))[0]
        if tag == INT32:
            return struct.unpack("<i", take(4))[0]
        if tag == FLOAT64:
            return struct.unpack("<d", take(8))[0]
        if tag == STRING:
            return text()
        if tag == ARRAY:
            return [value(depth + 1) for _ in range(number())]
        if tag == OBJECT:
            return {text(): value(depth + 1) for _ in range(number())}
        raise DecodingError(f"an unknown tag {tag}")

    out = value()
    if at != len(data):
        raise DecodingError("bytes after the value")
    return out


def content_hash(value) -> str:
    return hashlib.sha256(encode(value)).hexdigest()


def validate(value, depth: int = 0, held: tuple = ()) -> None:
    """Refuse what has no canonical form: other types, cycles, nesting beyond 50, prototype keys."""
    if depth > DEEPEST:
        raise ValidationError("nested too deeply")
    if isinstance(value, (dict, list, tuple)):
        if any(value is x for x in held):
            raise ValidationError("a cycle")
        for k in value if isinstance(value, dict) else ():
            if not isinstance(k, str) or k in ("__proto__", "constructor", "prototype"):
                raise ValidationError(f"a key that is not allowed: {k!r}")
        for x in value.values() if isinstance(value, dict) else value:
            validate(x, depth + 1, (*held, value))
    elif not (value is None or isinstance(value, (str, bool, int, float))):
        raise ValidationError(f"a type that is not allowed: {type(value).__name__}")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else canonical_text(t))


@F.pandas_udf(T.BinaryType())
def _encoded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else encode(json.loads(t)))


@F.pandas_udf(T.StringType())
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else json.dumps(decode(bytes(b)), ensure_ascii=False, separators=(",", ":")))


@F.pandas_udf(T.BooleanType())
def _valid(s: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else validate(json.loads(t)) is None
        except (ValidationError, ValueError):
            return False

    return s.map(one)


def valid(json_text: Column) -> Column:
    """Whether a JSON text has a canonical form."""
    return _valid(json_text)


def encoded(json_text: Column) -> Column:
    return _encoded(json_text)


def decoded(blob: Column) -> Column:
    return _decoded(blob)
