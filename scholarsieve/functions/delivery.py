"""Classify delivery receipts; only documented shapes count, the rest stays unknown."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from scholarsieve.functions.text import let


def receipt_status(receipt: Column) -> Column:
    """queued / confirmed / failed / unknown from a JSON status text or null."""
    def by_code(code):
        kind = F.coalesce(F.schema_of_variant(code), F.lit(""))
        return F.when(kind != "BIGINT", "unknown").when(F.variant_get(code, "$", "bigint") == 0, "confirmed").otherwise("failed")

    def by_body(body):
        # Status text may be a JSON string that holds the object once more.
        inner = F.try_parse_json(F.try_variant_get(body, "$", "string"))
        code = F.coalesce(F.try_variant_get(body, "$.errcode", "variant"), F.try_variant_get(inner, "$.errcode", "variant"))
        return F.when(code.isNull(), "unknown").otherwise(let(code, by_code))

    empty = receipt.isNull() | F.trim(receipt).isin("", "{}", '""', "null")
    looks_json = F.contains(receipt, F.lit("errcode"))
    return F.when(empty, "queued").when(~looks_json, "unknown").otherwise(let(F.try_parse_json(receipt), by_body))


def settle(outcome: Column) -> Column:
    """A queued send without a confirmation is recorded as unknown."""
    return F.when(outcome == "queued", "unknown").otherwise(outcome)
