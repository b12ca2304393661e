"""How document filters interact: every order of the filters at once, by wide packed counters.

A document's mask says which filters it fails. For k filters there are k! orders of k steps, and the mask alone
fixes what happens to a document at each of them, so each mask maps to one big integer whose 64-bit fields hold
every outcome of every step (0 or 1). A part's audit is the sum of the integers of its documents; each field then
holds a count. Documents are counted per mask first (in tasks, before any shuffle), so a part sums at most one
integer per mask, times its count. A field can't overflow into the next: the counts of a part are themselves
64-bit sums, and every field is at most their total, which is checked.

Identical texts (`E`) need the smallest id of each text: texts meet by SHA-256 after rows that agree in everything
are merged in their task; a text that a third of the table shares is one row per (source, mask, labels) there.

Nulls and edge cases: a null text is empty, a null source the part ''. Rows without an id have no label, are never
later copies and never make others copies. Equal rows are each counted, and none is a copy of its own id. A
doc_id that `labels` holds several times counts as good or toxic if any of its rows says so. An empty table has no
parts. Other columns are ignored, whatever their names.
"""
from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scholarsieve.llm.common import small_enough, stored

WORD = r"[^\x20\x09-\x0D]+"
COPY = "E"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides on its own."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.size(words) < 200,
            "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
            "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
            "D": text.rlike(r"[#$%&*|]")}


def masks(docs: DataFrame, labels: DataFrame, failing=conditions) -> DataFrame:
    """(part, mask, good, toxic, n): documents per part, failed filters and labels. Bit i of a mask is filter i;
    the last bit is an earlier identical text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    checks = failing(text)
    narrow = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
                         sum((F.when(check, F.lit(1 << i)).otherwise(0) for i, check in enumerate(checks.values())), F.lit(0)).alias("mask"))
    rows = stored(narrow.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "filter-rows")
    marks = stored(labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good or toxic"), "filter-labels")
    known = (rows.where("doc_id is not null").join(small_enough(marks, 16), "doc_id", "left")
             .withColumn("good", F.coalesce("good", F.lit(False))).withColumn("toxic", F.coalesce("toxic", F.lit(False))))
    marked = known.unionByName(rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    # Rows of one text: all of a group, those of its smallest id, and those without an id.
    texts = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("at_low"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    first = F.coalesce(F.col("low") == F.min("low").over(Window.partitionBy("digest")), F.lit(False))
    split = texts.withColumn("firsts", F.col("nameless") + F.when(first, F.col("at_low")).otherwise(0))
    later = F.struct((F.col("mask") + (1 << len(checks))).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))
    return (split.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("firsts").alias("n")), later)))
            .where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")))


def integers(filters: int) -> dict[tuple[int, bool, bool], int]:
    """The big integer of every (mask, good, toxic): fields by order, step and measure, lowest first."""
    orders = np.array(list(permutations(range(filters))))
    found = {}
    for mask in range(1 << filters):
        fails = (mask >> orders & 1).astype(bool)
        gone_after = np.logical_or.accumulate(fails, axis=1)
        gone_before = np.pad(gone_after, ((0, 0), (1, 0)))[:, :-1]
        here = fails & ~gone_before
        for good in (False, True):
            for toxic in (False, True):
                fields = np.stack([~gone_after, here, fails & gone_before, fails & (mask.bit_count() == 1), here & good, here & toxic], axis=-1)
                found[mask, good, toxic] = int.from_bytes(fields.astype("<u8").tobytes(), "little")
    return found


def unpack(total: int, filters: int, orders: int) -> np.ndarray:
    """Counts by order, step and measure."""
    shape = (orders, filters, len(MEASURES))
    return np.frombuffer(total.to_bytes(8 * int(np.prod(shape)), "little"), "<u8").reshape(shape).astype(np.int64)


def _auditor(letters: str):
    orders = ["".join(order) for order in permutations(letters)]
    column = np.array([[letters.index(c) for c in order] for order in orders])
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
                        *((name, pa.int64()) for name in (*MEASURES, "shapley"))])
    table: dict = {}

    def audit(part, group):
        if not table:
            table.update(integers(len(letters)))
        counts = group.column("n").to_pylist()
        if sum(counts) >= 1 << 63:
            raise OverflowError("a part holds more documents than a counter's field")
        keys = zip(*(group.column(name).to_pylist() for name in ("mask", "good", "toxic")))
        total = sum(n * table[key] for n, key in zip(counts, keys))
        found = unpack(total, len(letters), len(orders))
        removed = found[:, :, MEASURES.index("removed")]
        shapley = np.array([removed[column == i].sum() for i in range(len(letters))])
        steps = len(letters)
        return pa.Table.from_arrays(
            [pa.array([part[0].as_py()] * (len(orders) * steps)), pa.array(np.repeat(orders, steps).tolist()),
             pa.array(np.tile(np.arange(1, steps + 1), len(orders)), pa.int32()),
             *(pa.array(found[:, :, i].ravel()) for i in range(len(MEASURES))), pa.array(shapley[column].ravel())], schema=schema)

    return audit


def audit(docs: DataFrame, labels: DataFrame, failing=conditions) -> DataFrame:
    """One row per part, order of the filters and step: what is kept, removed and lost there."""
    letters = "".join(failing(F.lit(""))) + COPY
    longs = ", ".join(f"{name} long" for name in (*MEASURES, "shapley"))
    return masks(docs, labels, failing).groupBy("part").applyInArrow(_auditor(letters), f"part string, filter_order string, step int, {longs}")
