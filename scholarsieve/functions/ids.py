"""Paper identifiers, fingerprints and identifier safety tests."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from scholarsieve.functions.text import strip

# Identifier grammar.
_URL_PREFIX = r"^https?://(?:export\.)?arxiv\.org/(?:abs|pdf|html)/"
_BASE = r"[0-9]{4}\.[0-9]{4,5}|[a-zA-Z][a-zA-Z.\-]*/[0-9]{7}"
_VERSION = r"v[1-9][0-9]*"


def _bare(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(raw), _URL_PREFIX, ""), r"\.pdf$", "")


def _matched(raw: Column, pattern: str) -> Column:
    found = F.regexp_extract(_bare(raw), pattern, 1)
    return F.when(found != "", found)


def base_id(raw: Column) -> Column:
    """Version-less identifier, or null when malformed."""
    return _matched(raw, f"^({_BASE})(?:{_VERSION})?$")


def version_id(raw: Column) -> Column:
    """Identifier with its version where one was given, or null when malformed."""
    return _matched(raw, f"^((?:{_BASE})(?:{_VERSION})?)$")


def version_number(version: Column) -> Column:
    """Numeric version suffix; a missing version counts as 0."""
    return F.coalesce(F.regexp_extract(version, r"v([1-9][0-9]*)$", 1).try_cast("int"), F.lit(0))


def base_id_of(raw: str) -> str:
    """Driver form for a handful of user-supplied identifiers."""
    bare = re.sub(_URL_PREFIX, "", raw.strip()).removesuffix(".pdf")
    match = re.fullmatch(f"({_BASE})(?:{_VERSION})?", bare)
    if match is None:
        raise ValueError("invalid paper identifier")
    return match[1]


def abstract_url(version: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/abs/"), version)


def fingerprint(record: Column) -> Column:
    """sha256 of compact JSON; the struct's fields must be in alphabetical order."""
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def safe_token(value: Column, longest: int = 100) -> Column:
    """The value if it is a short plain token, else empty."""
    return F.when(value.rlike(rf"^[\p{{L}}\p{{N}}_.\-]{{1,{longest}}}$"), value).otherwise("")


def valid_digest_id(value: Column) -> Column:
    return value.rlike(r"^[a-zA-Z0-9\-]+$")


def valid_push_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_-]{1,120}$")
