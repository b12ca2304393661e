"""Queue, quota and ledger queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from scholarsieve.config import builtin
from scholarsieve.functions import clock
from scholarsieve.operators import ledger, ranking, state
from scholarsieve.plans import stand_ins as s
from scholarsieve.plans.registry import query, table

_PRICES = builtin()["llm"]["pricing"]
_PRIORITY = builtin()["selection"]["route_priority"]
_BY_PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _queue(spark, d):
    """Orders as selected papers: order priority is the route, price the score, date the day (unknown for some)."""
    orders = table(spark, d, "orders")
    route = F.element_at(F.array(*map(F.lit, _PRIORITY)), F.substring("o_orderpriority", 1, 1).cast("int"))
    place = F.array_position(F.array(*map(F.lit, _PRIORITY)), F.col("route"))
    return orders.withColumn("route", route).select(
        "o_orderkey", F.when(F.col("o_custkey") % 50 != 0, F.to_date("o_orderdate")).alias("day"), "route", "o_orderstatus",
        ranking.key(F.when(place == 0, 10).otherwise(place).alias("place"), (-F.col("o_totalprice")).alias("score"), "o_orderkey").alias("order"))


_QUEUE = f"""queue AS (
    SELECT o_orderkey, CASE WHEN o_custkey % 50 <> 0 THEN o_orderdate::DATE END AS day, [{', '.join(f"'{r}'" for r in _PRIORITY)}][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS route, o_orderstatus,
           CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS place, o_totalprice AS score FROM orders)"""


@query(f"""
    WITH {_QUEUE}
    SELECT o_orderkey, route, row_number() OVER (PARTITION BY day ORDER BY place, score DESC, o_orderkey) AS position FROM queue""")
def route_priority_rank(spark, d):
    return ranking.positions(_queue(spark, d), ["day"], "order").select("o_orderkey", "route", "position")


_FULL = 2


@query(f"""
    WITH {_QUEUE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY place, score DESC, o_orderkey) AS n FROM queue)
    SELECT o_orderkey, CASE WHEN n <= {_FULL} THEN 'full' WHEN o_orderstatus = 'P' THEN 'deferred' ELSE 'light_overflow' END AS outcome FROM ranked""")
def full_slot_overflow(spark, d):
    marked = ranking.mark_quota(_queue(spark, d), ["day"], "order", _FULL)
    return marked.select("o_orderkey", state.quota_outcome(F.col("within"), F.lit("full"), F.col("o_orderstatus") == "P").alias("outcome"))


@query(f"""
    WITH {_QUEUE}, counted AS (
        SELECT *, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY place, score DESC, o_orderkey
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM queue)
    SELECT o_orderkey, CASE WHEN before >= {_FULL} THEN 'light' WHEN o_orderstatus = 'F' THEN 'full' ELSE 'failed' END AS outcome FROM counted""")
def first_k_successes(spark, d):
    done = F.col("o_orderstatus") == "F"
    marked = ranking.mark_quota(_queue(spark, d), ["day"], "order", _FULL, counts=done)
    return marked.select("o_orderkey", F.when(~F.col("within"), "light").when(done, "full").otherwise("failed").alias("outcome"))


@query("""
    WITH errors AS (SELECT event_id, CASE WHEN user_id % 9 <> 0 THEN (ts + INTERVAL 8 HOUR)::DATE END AS day, value FROM events WHERE event_type = 'error'),
    used AS (SELECT day, count(*) AS n FROM errors WHERE value > 200 GROUP BY day),
    ranked AS (SELECT event_id, day, row_number() OVER (PARTITION BY day ORDER BY value DESC, event_id) AS rank FROM errors WHERE value <= 200)
    SELECT event_id, CAST(ranked.day AS VARCHAR) AS day, rank FROM ranked LEFT JOIN used ON ranked.day IS NOT DISTINCT FROM used.day WHERE rank <= 5 - coalesce(n, 0)""")
def review_topk_per_day(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'").select(
        "event_id", "value", F.when(F.col("user_id") % 9 != 0, clock.local_day(F.col("ts"))).alias("day"), ranking.key((-F.col("value")).alias("score"), "event_id").alias("order"))
    # Scores above 200 were reviewed earlier in the day and hold their slots.
    picks = ranking.fill_slots(errors.where("value <= 200"), errors.where("value > 200"), ["day"], "order", 5)
    return picks.select("event_id", F.col("day").cast("string").alias("day"), "rank")


@query("""
    WITH attempts AS (SELECT event_id, ts, CASE WHEN user_id % 9 <> 0 THEN (ts + INTERVAL 8 HOUR)::DATE END AS day FROM events WHERE event_type = 'purchase'),
    counted AS (SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS n FROM attempts)
    SELECT event_id, CASE WHEN n * 2 <= 5 THEN 'send' ELSE 'deferred' END AS outcome FROM counted""")
def send_quota_ledger(spark, d):
    attempts = table(spark, d, "events").where("event_type = 'purchase'").select(
        "event_id", F.when(F.col("user_id") % 9 != 0, clock.local_day(F.col("ts"))).alias("day"), ranking.key("ts", "event_id").alias("order"))
    return ledger.send_quota(attempts, "day", "order", daily_limit=5, poll_limit=1, polls_count=True).select("event_id", "outcome")


def _usage(spark, d):
    """Line items as model calls: price, part and quantity stand for token counts."""
    rows = table(spark, d, "lineitem")
    unknown = (F.col("l_partkey") % 97 == 0) & (F.col("l_linenumber") == 7)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_suppkey") % 10 != 0, F.date_format("l_shipdate", "yyyy-MM")).alias("run_id"),
        F.when(~unknown, F.col("l_extendedprice").cast("long")).alias("prompt_tokens"), F.col("l_partkey").alias("cached_tokens"),
        (F.col("l_quantity") * 10).cast("long").alias("completion_tokens"),
        ranking.key("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("order"))


_USAGE = """usage AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_suppkey, l_extendedprice, l_quantity, CASE WHEN l_suppkey % 10 <> 0 THEN strftime(l_shipdate, '%Y-%m') END AS run_id,
           CASE WHEN l_partkey % 97 = 0 AND l_linenumber = 7 THEN NULL ELSE CAST(trunc(l_extendedprice) AS BIGINT) END AS prompt_tokens,
           l_partkey AS cached_tokens, CAST(l_quantity * 10 AS BIGINT) AS completion_tokens FROM lineitem),
    priced AS (
    SELECT *, CASE WHEN prompt_tokens > 0 AND completion_tokens > 0 THEN round((least(prompt_tokens, cached_tokens) * 0.04::DOUBLE
           + (prompt_tokens - least(prompt_tokens, cached_tokens)) * 2.0::DOUBLE + completion_tokens * 8.0::DOUBLE) / 1000000, 8) END AS cost FROM usage)"""


@query(f"""
    WITH {_USAGE} SELECT l_orderkey, l_linenumber, l_partkey, round(cost, 6) AS cost FROM priced""")
def usage_cost(spark, d):
    return _usage(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.round(ledger.usage_cost(_PRICES), 6).alias("cost"))


_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(f"""
    WITH {_USAGE}, running AS (
        SELECT *, coalesce(sum(CAST(cost AS DECIMAL(28,8))) OVER w, 0) AS before, coalesce(sum(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) OVER w, 0) AS unknown
        FROM priced WINDOW w AS (PARTITION BY run_id ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN unknown > 0 THEN 'usage_unknown' WHEN before >= 20 THEN 'cost_cap' ELSE 'allowed' END AS guard FROM running""")
def cost_guard_cutoff(spark, d):
    priced = _usage(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "run_id", "order", ledger.usage_cost(_PRICES).alias("cost"))
    return ledger.guard_calls(priced, ["run_id"], "order", cap=20.0).select("l_orderkey", "l_linenumber", "l_partkey", "guard")


@query(f"""
    WITH {_USAGE} SELECT run_id, round(CAST(sum(CAST(cost AS DECIMAL(28,8))) AS DOUBLE), 4) AS spent,
           CASE WHEN count(*) FILTER (cost IS NULL) > 0 THEN 'usage_unknown' WHEN sum(CAST(cost AS DECIMAL(28,8))) >= 55 THEN 'cost_cap' ELSE 'allowed' END AS guard
    FROM priced GROUP BY run_id""")
def run_budget(spark, d):
    priced = _usage(spark, d).select("run_id", ledger.usage_cost(_PRICES).alias("cost"))
    return ledger.run_budget(priced, ["run_id"], cap=55.0).select("run_id", F.round(F.col("spent").cast("double"), 4).alias("spent"), "guard")
