"""The facade: datasets by name, queries, budgets, prompts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.scalar import token_estimate
from granary.functions.tokens import token_count
from granary.operators import budget as B
from granary.operators import render
from granary.plans.miniquery import filter_text, parse, select_rows
from granary.plans.models import models_table


@dataclass
class Result:
    """Rows of a query, rendered when asked."""

    data: DataFrame
    order: list[str]
    format: str = "json"

    def lines(self, fmt: str | None = None) -> DataFrame:
        return render.lines(self.data, fmt or self.format, self.order)

    def count(self) -> int:
        return self.data.count()

    def output(self, fmt: str | None = None) -> str:
        if (fmt or self.format) == "json":
            return render.pretty_json(self.data, self.order)
        return render.document(self.lines(fmt), self.order).first()["document"] or ""


class Engine:
    """Named datasets (DataFrames or tables) with their order columns."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._sets: dict[str, tuple[DataFrame, list[str]]] = {}

    def register(self, name: str, df: DataFrame, order: list[str]) -> None:
        self._sets[name] = (df, order)

    def drop(self, name: str) -> bool:
        return self._sets.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self._sets)

    def read(self, name: str) -> tuple[DataFrame, list[str]]:
        if name not in self._sets:
            return self.spark.createDataFrame([], "_ord long"), ["_ord"]
        return self._sets[name]

    def query(self, text: str) -> Result:
        q = parse(text)
        df, order = self.read(q.dataset)
        return Result(select_rows(df, q, order), order, q.format or "json")

    def context(self, name: str, filter_: str | None = None, limit: int | None = None, fmt: str = "tsv") -> Result:
        df, order = self.read(name)
        df = filter_text(df, filter_) if filter_ else df
        return Result(df.orderBy(*order).limit(limit) if limit and limit > 0 else df, order, fmt)

    def budget(self, name: str, model: str, formats: tuple[str, ...] = ("tsv", "csv", "markdown", "json_min"), prompt_tokens: int = 0, exact: bool = False) -> DataFrame:
        """format, rows, tokens, tokens_per_row, cost_per_1m (of a million requests): how much of the dataset fits a model's window, most rows first."""
        df, order = self.read(name)
        room, price = B.available(B.model(model)[2], prompt_tokens), B.model(model)[3]
        out = None
        for fmt in formats:
            # Every line costs a token at least: more lines than this cannot fit.
            rendered = render.lines(df, fmt, order).filter("part = 1").orderBy(*order).limit(room + 1)
            cost = token_count(F.col("line"), B.model(model)[1]) if exact else token_estimate(F.col("line"))
            one = B.rows_within(rendered, order, cost, room).withColumn("format", F.lit(fmt))
            out = one if out is None else out.unionByName(one)
        per = F.when(F.col("rows") > 0, F.ceil(F.col("tokens") / F.col("rows"))).otherwise(0).cast("long")
        out = out.select("format", "rows", "tokens", per.alias("tokens_per_row"), F.round(F.col("tokens") * F.lit(price), 2).alias("cost_per_1m"))
        return out.orderBy(F.col("rows").desc(), "format")

    def optimized_context(self, name: str, filter_: str | None, budget: int, sort_by: str | None = None, fmt: str = "csv", sort_first: bool = False) -> DataFrame:
        """Lines of the rows that fit: filtered, the first rows by the dataset's order, then sorted and rendered."""
        df, order = self.read(name)
        return optimized(df, order, filter_, budget, sort_by, fmt, sort_first)

    def savings(self, name: str) -> DataFrame:
        df, order = self.read(name)
        n = df.count()
        return B.savings(render.sizes(df, order).withColumn("rows", F.lit(n)), models_table(self.spark))


def optimized(df: DataFrame, order: list[str], filter_: str | None, budget: int, sort_by: str | None, fmt: str, sort_first: bool = False) -> DataFrame:
    """order columns, pos, line: see Engine.optimized_context."""
    rows = filter_text(df, filter_) if filter_ else df
    first = [sort_by, *order] if sort_first and sort_by else order
    row = {"csv": render.csv_row, "tsv": render.tsv_row, "markdown": render.markdown_row}[fmt](rows, [])
    # Every line costs a token at least: more rows than this cannot fit.
    rows = rows.orderBy(*first).limit(max(budget, 0) + 1).withColumn("line", row)
    used = F.sum(token_estimate(F.col("line")) + 1).over(Window.orderBy(*first)) - 1
    rows = rows.withColumn("_used", used).filter(F.col("_used") <= budget).drop("_used")
    key = F.col(f"`{sort_by}`").asc_nulls_last() if sort_by and sort_by in rows.columns else None
    keys = ([key] if key is not None else []) + [F.col(c) for c in order]
    return rows.select(*order, (F.row_number().over(Window.orderBy(*keys)) - 1).alias("pos"), "line")
