"""Usage cost, cost guard and daily send quota."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholarsieve.operators import ranking

_MONEY = "decimal(28,8)"


def _count(column: str) -> Column:
    return F.when(F.col(column) >= 0, F.col(column))


def usage_cost(pricing: dict) -> Column:
    """Estimated cost of a call in the price currency, null when unknown (never 0)."""
    hit, miss, out = (float(pricing[k]) for k in ("cache_hit_per_million", "cache_miss_per_million", "output_per_million"))
    if min(hit, miss, out) <= 0:
        return F.lit(None).cast("double")
    prompt, answer = _count("prompt_tokens"), _count("completion_tokens")
    cached = F.least(prompt, F.coalesce(_count("cached_tokens"), F.lit(0)))
    cost = (cached * hit + (prompt - cached) * miss + answer * out) / 1_000_000
    return F.when((prompt > 0) & (answer > 0), F.round(cost, 8))


def guard_calls(usage: DataFrame, group: list[str], order: str, cap: float) -> DataFrame:
    """Replay the run cost guard: a call goes ahead only while everything before it
    is priced and sums to less than the cap."""
    money = F.col("cost").cast(_MONEY)
    totals = ranking.running_totals(usage, group, order, {
        "spent": F.coalesce(money, F.lit(0).cast(_MONEY)), "unknown": F.col("cost").isNull().cast("long")})
    before = F.col("spent") - F.coalesce(money, F.lit(0).cast(_MONEY))
    unknown_before = F.col("unknown") - F.col("cost").isNull().cast("long")
    return totals.withColumn("guard", F.when(unknown_before > 0, "usage_unknown")
                             .when(before >= F.lit(cap).cast(_MONEY), "cost_cap").otherwise("allowed"))


def run_budget(usage: DataFrame, group: list[str], cap: float) -> DataFrame:
    """State of the guard after all calls of a run."""
    totals = usage.groupBy(*group).agg(F.sum(F.col("cost").cast(_MONEY)).alias("spent"),
                                       F.count_if(F.col("cost").isNull()).alias("unknown"))
    return totals.withColumn("guard", F.when(F.col("unknown") > 0, "usage_unknown")
                             .when(F.col("spent") >= F.lit(cap).cast(_MONEY), "cost_cap").otherwise("allowed"))


def send_quota(attempts: DataFrame, day: str, order: str, daily_limit: int, poll_limit: int, polls_count: bool) -> DataFrame:
    """Every send takes 1 unit plus its reserved status polls; later ones are deferred."""
    units = 1 + (poll_limit if polls_count else 0)
    marked = ranking.mark_quota(attempts, [day], order, daily_limit // units)
    return marked.withColumn("outcome", F.when(F.col("within"), "send").otherwise("deferred")).drop("within")
