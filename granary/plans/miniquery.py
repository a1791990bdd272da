"""The mini-query: GET dataset [WHERE field op value] [LIMIT n] [FORMAT name]."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import QueryError
from granary.functions.scalar import to_number, to_text
from granary.operators.dataset import ORDER, ordered

CANONICAL = re.compile(r"-?(0|[1-9][0-9]{0,14})(\.[0-9]*[1-9])?")


@dataclass(frozen=True)
class MiniQuery:
    dataset: str
    where: tuple[str, str, str] | None = None
    limit: int | None = None
    format: str | None = None


def parse(text: str) -> MiniQuery:
    """Words that are no clause are passed over, of repeated clauses the last holds, an incomplete WHERE is no clause."""
    words = text.split()
    if len(words) < 2 or words[0].upper() != "GET":
        raise QueryError(f"a query begins with GET and a dataset: {text!r}")
    where = limit = form = None
    k = 2
    while k < len(words):
        head, rest = words[k].upper(), words[k + 1 :]
        if head == "WHERE" and len(rest) >= 3:
            where, k = (rest[0], rest[1], rest[2]), k + 4
        elif head == "LIMIT" and rest:
            limit, k = (int(m[0]) if (m := re.match(r"[+-]?[0-9]+", rest[0])) else None), k + 2
        elif head == "FORMAT" and rest:
            form, k = rest[0].lower(), k + 2
        else:
            k += 1
    return MiniQuery(words[1], where, limit, form)


def predicate(df: DataFrame, field: str, op: str, value: str) -> Column:
    """Two-valued comparison: texts for equality (null is the empty text), numbers for ranges (null and blank are 0).

    Where a column is numeric and the value is a plain number, the predicate compares typed values, so
    that it can be pushed to the scan.
    """
    kind = df.schema[field].dataType if field in df.columns else None
    c = F.col(f"`{field}`") if kind is not None else None
    number = float(value) if CANONICAL.fullmatch(value) and value != "-0" else None
    typed = isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType) and number is not None
    if op in (">", "<", ">=", "<="):
        if typed:
            lit = F.lit(int(number) if number.is_integer() and isinstance(kind, T.IntegralType) else number)
            test = {">": c > lit, "<": c < lit, ">=": c >= lit, "<=": c <= lit}[op]
            zero = {">": number < 0, "<": number > 0, ">=": number <= 0, "<=": number >= 0}[op]
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                test = test & ~F.isnan(c)
            return c.isNull() | test if zero else test
        x = to_number(F.coalesce(to_text(c, kind), F.lit("")) if c is not None else F.lit(""))
        y = to_number(F.lit(value))
        return F.coalesce({">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op], F.lit(False))
    if typed:
        lit = F.lit(int(number) if number.is_integer() and isinstance(kind, T.IntegralType) else number)
        return (c.isNull() | (c != lit)) if op == "!=" else c == lit
    x = F.coalesce(to_text(c, kind), F.lit("")) if c is not None else F.lit("")
    return x != value if op == "!=" else x == value


def select_rows(df: DataFrame, q: MiniQuery, order: list[str]) -> DataFrame:
    """Filter, then the first rows by the order; a limit of zero, below, or absent means all."""
    if q.where:
        df = df.filter(predicate(df, *q.where))
    return df.orderBy(*order).limit(q.limit) if q.limit and q.limit > 0 else df


def filter_text(df: DataFrame, text: str) -> DataFrame:
    """A filter given as "field op value"."""
    q = parse(f"GET _ WHERE {text}")
    return df.filter(predicate(df, *q.where)) if q.where else df


def sort_stable(df: DataFrame, key: str | None, order: list[str], descending: bool = False, place: str | None = None) -> DataFrame:
    """By a key, nulls last in both directions, ties in the given order; an absent key changes nothing. place: a column for each row's number, without which the rows are only sorted."""
    by: list = list(order)
    if key is not None and key in df.columns:
        c = F.col(f"`{key}`")
        by.insert(0, c.desc_nulls_last() if descending else c.asc_nulls_last())
    return ordered(df, *by).withColumnRenamed(ORDER, place) if place else df.orderBy(*by)
