"""Datasets as token streams with control tokens, and their binary wrapper."""

from __future__ import annotations

import struct
from collections.abc import Callable

from granary.errors import DecodingError

# Fixed values of the format.
NULL, TRUE, FALSE = 200000, 200001, 200002
ROW_OPEN, ROW_CLOSE, SCHEMA, SCHEMA_REF, SEPARATOR = 200005, 200006, 200007, 200008, 200009
ROW, MASKED, ARRAY, ENTRY = 200012, 200013, 200014, 200015
MASK_BASE, LENGTH_BASE, ENTRY_BASE = 300000, 400000, 500000
MAGIC = b"TSTR\x02"
WIDEST = 200

Encode = Callable[[str], list[int]]
Decode = Callable[[list[int]], str]


def _value(v, encode: Encode, entries: dict[tuple[int, ...], int]) -> list[int]:
    if v is None:
        return [NULL]
    if v is True:
        return [TRUE]
    if v is False:
        return [FALSE]
    if isinstance(v, (list, tuple)):
        out = [ARRAY, LENGTH_BASE + len(v)]
        for x in v:
            out += _value(x, encode, entries) + [SEPARATOR]
        return out
    own = encode(_text(v))
    ref = entries.get(tuple(own))
    return [ENTRY_BASE + ref] if ref is not None else own


def _text(v) -> str:
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    return str(v)


def dictionary(rows: list[dict], encode: Encode) -> list[tuple[int, ...]]:
    """Token runs that pay as entries: count x length above length + count, by count."""
    counts: dict[tuple[int, ...], int] = {}
    for r in rows:
        for v in r.values():
            if v is not None and not isinstance(v, (bool, list, tuple)):
                t = tuple(encode(_text(v)))
                counts[t] = counts.get(t, 0) + 1
    paying = [t for t, n in counts.items() if n * len(t) > len(t) + n]
    return sorted(paying, key=lambda t: -counts[t])


def encode_rows(rows: list[dict], encode: Encode) -> list[int]:
    """One schema for up to 200 fields, with presence masks for rows with nulls; else a schema per row shape."""
    entries = {t: k for k, t in enumerate(dictionary(rows, encode))}
    out: list[int] = []
    for t, k in entries.items():
        out += [ENTRY, *encode(str(k)), SEPARATOR, *t, SEPARATOR]
    fields = list(dict.fromkeys(k for r in rows for k in r))
    shapes = [fields] if len(fields) <= WIDEST else [list(s) for s in dict.fromkeys(tuple(sorted(r)) for r in rows)]
    for s in shapes:
        out.append(SCHEMA)
        for f in s:
            out += [*encode(f), SEPARATOR]
    for r in rows:
        if len(shapes) == 1 and len(fields) <= WIDEST:
            values = [r.get(f) for f in fields]
            out.append(ROW)
            if any(v is None for v in values):
                out.append(MASKED)
                for c in range(0, len(fields), 16):
                    out.append(MASK_BASE + sum(1 << b for b, v in enumerate(values[c : c + 16]) if v is not None))
                values = [v for v in values if v is not None]
            for v in values:
                out += [*_value(v, encode, entries), SEPARATOR]
        else:
            k = shapes.index(sorted(r))
            out += [SCHEMA_REF, k, ROW_OPEN]
            for f in shapes[k]:
                out += [*_value(r[f], encode, entries), SEPARATOR]
            out.append(ROW_CLOSE)
    return out


def decode_rows(tokens: list[int], decode: Decode) -> list[dict]:
    """Rows as texts, booleans, nulls and arrays of these: the stream holds no types of numbers."""
    at = 0
    entries: dict[int, tuple[int, ...]] = {}
    shapes: list[list[str]] = []
    rows: list[dict] = []

    def until_separator() -> list[int]:
        nonlocal at
        begin = at
        while at < len(tokens) and tokens[at] != SEPARATOR:
            at += 1
        if at >= len(tokens):
            raise DecodingError("the stream ends in a value")
        at += 1
        return tokens[begin : at - 1]

    def value():
        nonlocal at
        if at < len(tokens) and tokens[at] == ARRAY:
            n = tokens[at + 1] - LENGTH_BASE
            at += 2
            out = [value() for _ in range(n)]
            if at >= len(tokens) or tokens[at] != SEPARATOR:
                raise DecodingError("an array without an end")
            at += 1
            return out
        own = until_separator()
        if len(own) == 1 and own[0] in (NULL, TRUE, FALSE):
            return (None, True, False)[own[0] - NULL]
        if len(own) == 1 and own[0] >= ENTRY_BASE:
            own = list(entries.get(own[0] - ENTRY_BASE, ()))
        return decode(own)

    while at < len(tokens):
        t = tokens[at]
        at += 1
        if t == ENTRY:
            k = int(decode(until_separator()))
            entries[k] = tuple(until_separator())
        elif t == SCHEMA:
            own = []
            while at < len(tokens) and tokens[at] not in (SCHEMA, ROW, SCHEMA_REF, ENTRY):
                own.append(decode(until_separator()))
            shapes.append(own)
        elif t == ROW:
            fields = shapes[0]
            present = [True] * len(fields)
            if at < len(tokens) and tokens[at] == MASKED:
                at += 1
                for c in range(0, len(fields), 16):
                    bits = tokens[at] - MASK_BASE
                    at += 1
                    for b in range(min(16, len(fields) - c)):
                        present[c + b] = bool(bits >> b & 1)
            rows.append({f: value() if p else None for f, p in zip(fields, present, strict=True)})
        elif t == SCHEMA_REF:
            fields = shapes[tokens[at]]
            at += 2
            rows.append({f: value() for f in fields})
            at += 1
        else:
            raise DecodingError(f"an unexpected token {t}")
    return rows


def to_binary(tokens: list[int], encoding: str) -> bytes:
    name = encoding.encode()
    return MAGIC + bytes([len(name)]) + name + struct.pack(f"<I{len(tokens)}I", len(tokens), *tokens)


def from_binary(data: bytes) -> tuple[str, list[int]]:
    if data[: len(MAGIC)] != MAGIC:
        raise DecodingError("an unknown header")
    n = data[len(MAGIC)]
    at = len(MAGIC) + 1 + n
    if len(data) < at + 4:
        raise DecodingError("the data end too early")
    (count,) = struct.unpack_from("<I", data, at)
    if len(data) != at + 4 + 4 * count:
        raise DecodingError("a wrong length")
    return data[len(MAGIC) + 1 : at].decode(), list(struct.unpack_from(f"<{count}I", data, at + 4))
