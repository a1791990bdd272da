"""The record text format for one document: writing and reading on the driver or in a function."""

from __future__ import annotations

import json
import re

from granary.errors import DecodingError

NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
SPLIT = re.compile(r'"(?:[^"\\]|\\.)*"|\S+')
UNESCAPE = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}


def unquoted(word: str) -> str:
    return re.sub(r"\\(.)", lambda m: UNESCAPE.get(m[1], m[1]), word[1:-1])


def value_of(word: str, kind: str, dictionary: list[str]):
    """A word by its declared type; quoted words are text, a bad reference is null."""
    if word.startswith('"'):
        return unquoted(word)
    if word == "_":
        return None
    if re.fullmatch(r"@\d+", word):
        k = int(word[1:])
        return dictionary[k] if k < len(dictionary) else None
    if kind == "bool" or kind == "str" and word in ("true", "false"):
        return word == "true" if word in ("true", "false") else word
    if kind == "num" and NUMBER.fullmatch(word):
        n = float(word)
        return int(n) if n.is_integer() and abs(n) < 2**53 and "." not in word and "e" not in word.lower() else n
    return word


def decode(text: str) -> list[dict]:
    """Rows of a document; unknown directives are passed over, missing arrays are empty, other missing fields null."""
    fields: dict[str, str] = {}
    name, dictionary, rows, row = None, [], [], None
    for line in text.split("\n"):
        if line.startswith("@schema "):
            name, *parts = line[8:].split()
            fields = dict(p.rsplit(":", 1) for p in parts if ":" in p)
        elif line.startswith("@dict "):
            dictionary = [unquoted(w) if w.startswith('"') else w for w in SPLIT.findall(line[6:])]
        elif line.startswith("@") or not line.strip():
            continue
        elif line.startswith("  "):
            if row is None:
                raise DecodingError("a field before any record")
            k, _, rest = line[2:].partition(" ")
            kind = fields.get(k, "str?")
            for_type = kind.rstrip("?").removesuffix("[]")
            v = value_of((SPLIT.findall(rest) or ['""'])[0], for_type, dictionary)
            if "[]" in kind:
                row.setdefault(k, []).append(v)
            else:
                row[k] = v
        elif line == name:
            row = {}
            rows.append(row)
    for row in rows:
        for k, kind in fields.items():
            row.setdefault(k, [] if "[]" in kind else None)
    return [{k: row[k] for k in [*fields, *(x for x in row if x not in fields)]} for row in rows]


def quoted(s: str) -> str:
    special = s == "" or s in ("_", "true", "false") or NUMBER.fullmatch(s) or re.search(r'[\s"\\|>,={}\[\]@#]', s)
    if not special:
        return s
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = s.replace(raw, code)
    return f'"{s}"'


def word_of(v, ids: dict[str, int]) -> str:
    if v is None:
        return "_"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return f"@{ids[v]}" if v in ids else quoted(v)
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            return '"NaN"' if v != v else '"Infinity"' if v > 0 else '"-Infinity"'
        return str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v)
    if isinstance(v, int):
        return str(v)
    return quoted(json.dumps(v, ensure_ascii=False, separators=(",", ":")))


def _type_of(values: list, nulls: bool) -> str:
    array = any(isinstance(v, list) for v in values)
    flat = [x for v in values for x in (v if isinstance(v, list) else [v]) if x is not None]
    if not flat and not array:
        return "str?"
    kinds = {"bool" if isinstance(x, bool) else "num" if isinstance(x, (int, float)) else "str" for x in flat}
    return (kinds.pop() if len(kinds) == 1 else "str") + ("[]" if array else "") + ("?" if nulls else "")


def encode(rows: list[dict], name: str = "data", encoding: str = "o200k_base") -> str:
    fields = list(dict.fromkeys(k for r in rows for k in r))
    types = {k: _type_of([r[k] for r in rows if r.get(k) is not None], any(r.get(k) is None for r in rows)) for k in fields}
    counts: dict[str, int] = {}
    for r in rows:
        for k in fields:
            for x in r[k] if isinstance(r.get(k), list) else [r.get(k)]:
                if isinstance(x, str):
                    counts[x] = counts.get(x, 0) + 1
    ids: dict[str, int] = {}
    for s in sorted((s for s, n in counts.items() if n > 1), key=lambda s: -counts[s] * len(s))[:10_000]:
        ref = 1 + len(str(len(ids)))
        if len(s) > ref or len(s) == ref and counts[s] >= 3:
            ids[s] = len(ids)
    out = ["@version 1", f"@encoding {encoding}", f"@schema {name}" + "".join(f" {k}:{t}" for k, t in types.items())]
    if rows:
        out += [""] + (["@dict " + " ".join(map(quoted, ids)), ""] if ids else [])
    for r in rows:
        out.append(name)
        for k in fields:
            v = r.get(k)
            if isinstance(v, list):
                out += [f"  {k} {word_of(x, ids)}" for x in v]
            elif "[]" not in types[k]:
                out.append(f"  {k} {word_of(v, ids)}")
    return "\n".join(out)
