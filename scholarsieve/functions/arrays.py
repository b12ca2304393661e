"""Array helpers over built-in functions: state machines, runs and occurrence numbers, linear in practice."""
from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from scholarsieve.functions.text import let

BLOCK = 128


def built_once(build):
    """Keep what a builder makes of column names: a large expression takes thousands of calls to the driver's JVM."""
    kept: dict = {}

    @wraps(build)
    def get(*names: str) -> Column:
        key = id(SparkContext._gateway), *names
        if key not in kept:
            kept[key] = build(*names)
        return kept[key]

    return get


def scan(items: Column, state: Column, step, out_type: str) -> Column:
    """Outputs of a state machine over an array; `step(state, item)` gives a struct of `state` and `out`.

    Outputs are gathered per block of items and the blocks joined, so appending copies little.
    """
    nothing = F.array().cast(f"array<{out_type}>")

    def advance(done, item):
        return let(step(done["state"], item), lambda r: F.struct(r["state"].alias("state"), F.concat(done["out"], F.array(r["out"])).alias("out")))

    def block(done, part):
        inner = F.aggregate(part, F.struct(done["state"].alias("state"), nothing.alias("out")), advance)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(done["out"], r["out"]).alias("out")))

    def blocks(all_items):
        starts = F.sequence(F.lit(0), F.greatest(F.size(all_items) - 1, F.lit(0)), F.lit(BLOCK))
        parts = F.transform(starts, lambda s: F.slice(all_items, s + 1, F.lit(BLOCK)))
        return F.aggregate(parts, F.struct(state.alias("state"), nothing.alias("out")), block, lambda done: done["out"])

    return let(items, blocks)


def runs(items: Column, key) -> Column:
    """Neighbouring items with equal keys as arrays."""
    def cut(all_items):
        places = F.transform(all_items, lambda x, i: i)
        starts = F.filter(places, lambda i: (i == 0) | ~key(F.get(all_items, i)).eqNullSafe(key(F.get(all_items, i - 1))))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.slice(all_items, at + 1, F.coalesce(F.get(s, k + 1), F.size(all_items)) - at)))

    return let(items, cut)


def occurrence_numbers(names: Column) -> Column:
    """For each name of an array: how often it has come up so far, itself included."""
    placed = F.array_sort(F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("at"))))
    numbered = F.flatten(F.transform(runs(placed, lambda x: x["name"]), lambda run: F.transform(run, lambda x, k: F.struct(x["at"].alias("at"), (k + 1).alias("n")))))
    return F.transform(F.array_sort(numbered), lambda x: x["n"])
