"""Token budgets: how many rows fit, which items to pack, how to compose a prompt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.errors import BudgetExceededError, WindowExceededError
from granary.functions.scalar import half_up
from granary.plans.models import model

RESERVE, MARGIN = 4096, 0.05


def available(window: int, prompt_tokens: int = 0, reserve: int = RESERVE, margin: float = MARGIN) -> int:
    return max(0, int(np.floor((window - prompt_tokens - reserve) * (1 - margin))))


def available_column(window: Column, prompt_tokens: int = 0, reserve: int = RESERVE, margin: float = MARGIN) -> Column:
    """As available, for a column of windows."""
    return F.greatest(F.lit(0), F.floor((window - prompt_tokens - reserve) * F.lit(1 - margin))).cast("long")


def cheapest(costs: DataFrame, by: list[str]) -> DataFrame:
    """by, best, cost of (by, format, cost) rows: the format with the smallest cost, then the first by name."""
    return costs.groupBy(*by).agg(F.min_by("format", F.struct("cost", "format")).alias("best"), F.min("cost").alias("cost"))


def marginal_cost(lines: DataFrame, place: str, tokens: str, marks: list[int]) -> DataFrame:
    """from_rows, to_rows, tokens_per_row between marks of a dataset whose lines are numbered from 1; marks beyond its end are passed over."""
    g = lines.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col(place) <= m, F.col(tokens))).alias(str(m)) for m in marks])
    steps = [F.struct(F.lit(a).cast("long").alias("from_rows"), F.lit(b).cast("long").alias("to_rows"), F.round((F.col(f"`{b}`") - F.col(f"`{a}`")) / (b - a), 6).alias("tokens_per_row")) for a, b in zip(marks, marks[1:])]
    return g.select("n", F.explode(F.array(*steps)).alias("s")).filter("s.to_rows <= n").select("s.*")


def cache_control(text: Column, least: int = 3500) -> Column:
    """Whether a block is long enough to be marked for a provider's prompt cache."""
    return F.length(text) > least


def rows_within(lines: DataFrame, order: list[str], tokens: Column, budget: int, by: list[str] | None = None) -> DataFrame:
    """by, rows, tokens: the longest prefix of lines (in order, line feeds between them count one token) within the budget.

    Every line costs a token at least, so that without groups only the first budget + 1 lines are
    looked at, whatever there are; they come from a top-k, not a full sort.
    """
    by = by or []
    w = Window.partitionBy(*by).orderBy(*order)
    if not by:
        lines = lines.orderBy(*order).limit(max(budget, 0) + 1)
    t = lines.select(*by, *order, tokens.alias("t"))
    t = t.withColumn("used", F.sum(F.col("t") + 1).over(w) - 1)
    return t.filter(F.col("used") <= budget).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("used"), F.lit(0)).alias("tokens"))


def rows_within_large(lines: DataFrame, order: str, tokens: Column, budget: int, bins: int = 1024) -> DataFrame:
    """As rows_within for one large dataset with a numeric order: bins of the order are summed up, and only the bin where the budget ends is looked at line by line."""
    t = lines.select(F.col(order).cast("long").alias("o"), tokens.cast("long").alias("t"))
    ends = t.agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
    t = t.crossJoin(F.broadcast(ends)).withColumn("bin", F.floor((F.col("o") - F.col("lo")) * bins / (F.col("hi") - F.col("lo") + 1)))
    per = t.groupBy("bin").agg(F.sum(F.col("t") + 1).alias("words"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bin")
    per = per.withColumn("upto", F.sum("words").over(w) - 1).withColumn("rows", F.sum("n").over(w))
    full = per.filter(F.col("upto") <= budget).agg(F.coalesce(F.max("bin"), F.lit(-1)).alias("last"), F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("upto"), F.lit(-1)).alias("upto"))
    edge = per.crossJoin(F.broadcast(full)).filter("bin > last").agg(F.min("bin").alias("edge"))
    part = t.crossJoin(F.broadcast(edge)).crossJoin(F.broadcast(full.withColumnRenamed("rows", "r0"))).filter("bin = edge")
    part = part.withColumn("used", F.col("upto") + F.sum(F.col("t") + 1).over(Window.orderBy("o"))).filter(F.col("used") <= budget)
    part = part.agg(F.count(F.lit(1)).alias("r"), F.max("used").alias("u"))
    return full.crossJoin(part).select((F.col("rows") + F.col("r")).alias("rows"), F.greatest(F.coalesce("u", F.lit(0)), F.greatest("upto", F.lit(0))).alias("tokens"))


def truncated(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def item_score(priority: Column, recency: Column, relevance: Column, w: tuple[float, float, float] = (0.5, 0.2, 0.3)) -> Column:
    """Weighted priority (0 to 100), recency and relevance (0 to 1, missing 0.5); priority zero scores zero."""
    half = F.lit(0.5)
    return F.when(priority == 0, 0.0).otherwise(priority / 100 * w[0] + F.coalesce(recency, half) * w[1] + F.coalesce(relevance, half) * w[2])


def packed(items: DataFrame, budget: int, by: list[str], how: str = "greedy") -> DataFrame:
    """by, id, tokens, score, selected, reason: items taken within the budget of each group.

    greedy goes by score, density by score per token; an item that doesn't fit is passed over. The
    fold holds one group's items, as one prompt's items do; knapsack is exact up to 200 items and
    50,000 tokens, beyond that it is density.
    """
    if how == "knapsack":
        return _knapsack(items, budget, by)
    zero = F.lit(how == "density") & (F.col("tokens") == 0)
    rank = F.try_divide(F.col("score"), F.col("tokens")) if how == "density" else F.col("score")
    entry = F.struct((-F.coalesce(rank, F.lit(0.0))).alias("k"), "id", "tokens", "score", zero.alias("zero"))
    group = items.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc, x):
        fits = ~x["zero"] & (x["score"] != 0) & (x["tokens"] <= acc["left"])
        return F.struct((acc["left"] - F.when(fits, x["tokens"]).otherwise(0)).cast("long").alias("left"), F.concat(acc["taken"], F.array(fits)).alias("taken"))

    folded = group.withColumn("f", F.aggregate("items", start, step))
    out = folded.select(*by, F.explode(F.arrays_zip("items", F.col("f.taken").alias("taken"))).alias("z"))
    out = out.select(*by, "z.items.id", "z.items.tokens", "z.items.score", "z.items.zero", F.col("z.taken").alias("selected"))
    reason = F.when(F.col("zero"), "too_large").when(F.col("score") == 0, "zero_priority").when(~F.col("selected"), "over_budget")
    return out.withColumn("reason", reason).drop("zero")


def _knapsack(items: DataFrame, budget: int, by: list[str]) -> DataFrame:
    schema = ", ".join([f"{c} {items.schema[c].dataType.simpleString()}" for c in by] + [f"{c} {items.schema[c].dataType.simpleString()}" for c in ("id", "tokens", "score")] + ["selected boolean", "reason string"])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable").reset_index(drop=True)
        live = g.index[(g.score > 0) & (g.tokens > 0)]
        taken = np.zeros(len(g), bool)
        if len(live) > 200 or budget > 50_000:
            left = budget
            for k in sorted(live, key=lambda k: -g.score[k] / g.tokens[k]):
                if g.tokens[k] <= left:
                    taken[k] = True
                    left -= g.tokens[k]
        else:
            best, keep = np.zeros(budget + 1), []
            for k in live:
                t, v = int(g.tokens[k]), np.floor(g.score[k] * 1000 + 0.5)
                better = np.zeros(budget + 1, bool)
                if t <= budget:
                    with_it = best[: budget + 1 - t] + v
                    better[t:] = with_it > best[t:]
                    best[t:] = np.maximum(best[t:], with_it)
                keep.append(better)
            left = budget
            for k, better in zip(reversed(live), reversed(keep), strict=True):
                if better[left]:
                    taken[k] = True
                    left -= int(g.tokens[k])
        reason = np.where(g.score == 0, "zero_priority", np.where(g.tokens == 0, "too_large", np.where(taken, None, "over_budget")))
        return g[[*by, "id", "tokens", "score"]].assign(selected=taken, reason=reason)

    return items.select(*by, "id", "tokens", "score").groupBy(*by).applyInPandas(solve, schema)


def pack_result(chosen: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """by, items, tokens, utilization in percent with one digit, score with three."""
    on = F.col("selected")
    g = chosen.groupBy(*by).agg(F.count(F.when(on, 1)).alias("items"), F.coalesce(F.sum(F.when(on, F.col("tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(on, F.col("score"))), F.lit(0.0)).alias("s"))
    return g.select(*by, "items", "tokens", (half_up(F.col("tokens") * 1000 / budget) / 10).alias("utilization"), (half_up(F.round(F.col("s"), 9) * 1000) / 1000).alias("score"))


def composed(blocks: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """by, ord, name, included, tokens, reason: prompt blocks (ord, name, required, tokens, max_tokens) in order within a budget.

    Blocks are cut to their own limit first; an optional block that doesn't fit is cut to what is
    left, or left out. ``overflow`` tells that a required block did not fit.
    """
    own = F.when((F.col("max_tokens") > 0) & (F.col("tokens") > F.col("max_tokens")), F.col("max_tokens")).otherwise(F.col("tokens")).cast("long")
    entry = F.struct("ord", "name", "required", own.alias("tokens"))
    g = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("blocks"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("got"))

    def step(acc, x):
        left = F.lit(budget).cast("long") - acc["used"]
        got = F.when(x["tokens"] <= left, x["tokens"]).when(x["required"], F.lit(-1).cast("long")).otherwise(left)
        return F.struct((acc["used"] + F.greatest(got, F.lit(0).cast("long"))).cast("long").alias("used"), F.concat(acc["got"], F.array(got)).alias("got"))

    f = g.withColumn("f", F.aggregate("blocks", start, step)).select(*by, F.explode(F.arrays_zip("blocks", F.col("f.got").alias("got"))).alias("z"))
    f = f.select(*by, "z.blocks.ord", "z.blocks.name", "z.blocks.required", F.col("z.blocks.tokens").alias("wanted"), "z.got")
    reason = F.when(F.col("got") < 0, "overflow").when(F.col("got") == F.col("wanted"), None).when(F.col("got") > 0, "truncated").otherwise("budget full")
    return f.select(*by, "ord", "name", ((F.col("got") > 0) | (F.col("got") == F.col("wanted"))).alias("included"), F.greatest("got", F.lit(0)).alias("tokens"), reason.alias("reason"))


def compose(blocks: DataFrame, model_name: str, by: list[str], reserve: int = RESERVE) -> DataFrame:
    """composed() within a model's window; a required block that doesn't fit is an error."""
    budget = model(model_name)[2] - reserve
    if budget <= 0:
        raise BudgetExceededError(f"{model_name} leaves no tokens")
    out = composed(blocks, budget, by)
    bad = out.filter("reason = 'overflow'").first()
    if bad:
        raise WindowExceededError(f"required block {bad['name']} does not fit")
    return out


def savings(sizes: DataFrame, models: DataFrame) -> DataFrame:
    """(format, tokens, rows) x models: cost per thousand calls and per year at ten thousand a day, and rows that fit half the window."""
    j = sizes.crossJoin(F.broadcast(models))
    per_k = F.col("tokens") / 1e6 * F.col("input_price") * 1000
    fit = F.floor(F.try_divide(F.lit(0.5) * F.col("window"), F.col("tokens") / F.col("rows")))
    return j.select("format", "model", "tokens", F.round(per_k, 6).alias("cost_per_1k"), F.round(per_k * 10 * 365, 4).alias("annual"), fit.alias("rows_that_fit"))


def format_choice(rows: Column, sparsity: Column, pressure: Column, depth: Column) -> Column:
    return F.when(rows < 5, "json").when(sparsity > 0.8, "json").when(pressure > 0.3, "compact").when(depth > 2, "compact").otherwise("compact")


def expected_savings(depth: Column, fields: Column, rows: Column, text_cells: Column, number_cells: Column) -> Column:
    gain = F.lit(0.35) + F.when(depth > 2, 0.15).otherwise(0.0) + F.when(fields > 10, 0.05).otherwise(0.0) + F.when(rows > 20, 0.05).otherwise(0.0) + F.when(text_cells > number_cells, 0.05).otherwise(0.0)
    return F.least(F.lit(0.95), gain)


def confidence(best: Column, second: Column, score: Column, compact: Column, agrees: Column) -> Column:
    """0 to 100: how sure the cheapest strategy is."""
    margin = F.coalesce(F.try_divide((second - best) * 100, second), F.lit(0.0))
    shape = F.when(compact, F.least(F.lit(25.0), F.greatest(F.lit(0.0), score * 0.25))).otherwise(F.least(F.lit(20.0), F.greatest(F.lit(0.0), (100 - score) * 0.2)))
    raw = F.lit(40.0) + F.least(F.lit(20.0), F.greatest(F.lit(0.0), margin)) * 1.4 + shape + F.when(agrees, 12).otherwise(-10)
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(raw))).cast("int")


def confidence_level(c: Column) -> Column:
    return F.when(c >= 75, "high").when(c >= 55, "medium").otherwise("low")


def token_cap(flag: Column, preset: Column, window: Column, share: float = 0.4) -> Column:
    return F.coalesce(flag, preset, F.floor(window * share)).cast("long")


def cache_outcome(strategy_: Column, provider_cached: Column, local_hit: Column) -> Column:
    return (
        F.when(provider_cached > 0, F.when(local_hit, "provider_and_local_hit").otherwise("provider_hit"))
        .when(local_hit, "local_hit")
        .when(strategy_.isin("json", "none"), "not_cacheable")
        .otherwise("miss")
    )


def reality_gate(consistency: Column, reduction: Column, deterministic: Column, guarded: Column) -> Column:
    return (consistency >= 90) & (reduction >= 15) & deterministic & guarded
