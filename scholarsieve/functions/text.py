"""Text folding, phrase tests, escapes and scrubbing as JVM-side Column expressions.

Only rows holding characters outside a verified safe set visit Python, in Arrow
batches, because Spark has no NFKC or casefold.
"""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Dash code points, Unicode whitespace and word characters.
DASHES = r"\u2010-\u2015\u2212\ufe58\ufe63\uff0d\-"
SPACES = r"\s\x0b\x1c-\x1f\x85 \p{Z}"
WORD = r"\p{L}\p{N}_"
_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")

# For these characters NFKC + casefold equals lower() plus ß -> ss, and only the
# dashes among them are separators: ASCII, Latin-1 letters, dashes U+2010..2015 and
# quotation marks U+2018..201F.
_UNSAFE = r"[^\x00-\x7f\u00c0-\u00ff\u2010\u2012-\u2015\u2018-\u201f]"
_LATIN_DASHES = "-\u2010\u2012\u2013\u2014\u2015"


def match_form_of(text: str) -> str:
    """Form used for phrase rules: NFKC, casefold, dashes and spaces folded."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return re.sub(r"\s+", " ", re.sub(f"[{DASHES}]", " ", folded)).strip()


def quote_form_of(text: str) -> str:
    """Form used for quotes: like match_form but dashes stay."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip().casefold()


@F.pandas_udf(T.StringType())
def _match_form_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else match_form_of(t))


@F.pandas_udf(T.StringType())
def _quote_form_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else quote_form_of(t))


def let(value: Column, use) -> Column:
    """Bind a computed value once for an expression that needs it several times."""
    return F.get(F.transform(F.array(value), use), 0)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _squeeze(text: Column, dashes: str = "") -> Column:
    """Runs of ASCII whitespace (and given dashes) to one blank, ends trimmed.

    Text mostly holds a few kinds of separators in short runs: literal replacements
    handle those at memory speed, and the regular expression sees only the rest.
    """
    for mark in "\n\t\r" + dashes:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    for _ in range(3):
        text = F.replace(text, F.lit("  "), F.lit(" "))

    def finish(t):
        left = F.contains(t, F.lit("  "))
        for mark in "\x0b\x0c\x1c\x1d\x1e\x1f":
            left = left | F.contains(t, F.lit(mark))
        return F.trim(F.when(left, F.regexp_replace(t, r"[ \t-\r\x1c-\x1f]+", " ")).otherwise(t))

    return let(text, finish)


def _lower(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def match_form(text: Column) -> Column:
    rare = F.when(~_is_ascii(text) & text.rlike(_UNSAFE), text)
    return F.coalesce(_match_form_batch(rare), _squeeze(_lower(text), _LATIN_DASHES))


def quote_form(text: Column) -> Column:
    rare = F.when(~_is_ascii(text) & text.rlike(_UNSAFE), text)
    return F.coalesce(_quote_form_batch(rare), _squeeze(_lower(text)))


def strip(text: Column) -> Column:
    """Without whitespace of any kind at either end."""
    return F.btrim(text, F.lit(_WHITESPACE))


def blank(text: Column) -> Column:
    """Null, empty or only whitespace."""
    return F.coalesce(strip(text), F.lit("")) == ""


def collapse(text: Column) -> Column:
    """Unicode whitespace runs to one space, ends trimmed."""
    exotic = ~_is_ascii(text) & text.rlike(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    return F.when(exotic, F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))).otherwise(_squeeze(text))


def _literal(text: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", text)


def phrase_pattern(phrases) -> str | None:
    """One alternation for a whole phrase group, bounded by Unicode word edges."""
    needles = [n for n in (match_form_of(p) for p in dict.fromkeys(phrases)) if n]
    if not needles:
        return None
    # Testing the first letter before the look-behind skips most positions cheaply.
    first = "".join(sorted({_literal(n[0]) for n in needles}))
    return f"(?=[{first}])(?<![{WORD}])(?:{'|'.join(_literal(n) for n in needles)})(?![{WORD}])"


def has_phrase(folded: Column, phrases) -> Column:
    """Does already folded text hold any of the phrases?

    The plain substring test runs first: it is far cheaper than the regular
    expression and rejects most rows.
    """
    pattern = phrase_pattern(phrases)
    if pattern is None:
        return F.lit(False)
    needles = sorted({match_form_of(p) for p in phrases} - {""}, key=len)
    roots = [n for i, n in enumerate(needles) if not any(s in n for s in needles[:i])]
    if len(roots) > 12:
        return folded.rlike(pattern)
    present = F.contains(folded, F.lit(roots[0]))
    for root in roots[1:]:
        present = present | F.contains(folded, F.lit(root))
    return present & folded.rlike(pattern)


def _replace_all(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def markdown_text(text: Column) -> Column:
    """Plain inline Markdown: one line, entities, then backslash escapes."""
    escapes = [(c, "\\" + c) for c in ("\\", "`", "*", "_", "[", "]", "|", "#")]
    return _replace_all(collapse(text), (*_ENTITIES, *escapes))


def table_cell(text: Column) -> Column:
    return _replace_all(collapse(text), (*_ENTITIES, ("|", "&#124;"), ("\\", "&#92;")))


def digest_title(text: Column) -> Column:
    return _replace_all(collapse(text), (("[", "\\["), ("]", "\\]")))


def html_escape(text: Column) -> Column:
    return _replace_all(text, (*_ENTITIES, ('"', "&quot;"), ("'", "&#x27;")))


# Keys dropped from public records.
FORBIDDEN_KEYS = ("api_key", "sendkey", "readkey", "authorization", "reasoning_content",
                  "raw_response", "raw_exception", "image_path")


def scrub(text: Column, secrets=()) -> Column:
    """Remove known secret values (longest first) and credential-shaped text."""
    for secret in sorted({s for s in secrets if s}, key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    text = F.regexp_replace(text, f"(?i)(bearer[{SPACES}]+)[{WORD}.\\-]+", "$1[REDACTED]")
    text = F.regexp_replace(text, f"(?i)([?&](?:readkey|sendkey|api_key|token|key)=)[^{SPACES}&#)]+", "$1[REDACTED]")
    return F.regexp_replace(text, f"https://sctapi\\.ftqq\\.com/[^/{SPACES}]+\\.send",
                            "https://sctapi.ftqq.com/[REDACTED].send")


def drop_forbidden(pairs: Column) -> Column:
    """Drop forbidden keys of a map column."""
    return F.map_filter(pairs, lambda key, _: ~F.lower(key).isin(*FORBIDDEN_KEYS))


def _public(value: Column, kind: T.DataType, secrets) -> Column | None:
    """A value without forbidden fields at any depth and with scrubbed texts; None if nothing is left of its type."""
    if isinstance(kind, T.StringType):
        return scrub(value, secrets)
    if isinstance(kind, T.ArrayType):
        if _public(F.lit(None).cast(kind.elementType), kind.elementType, secrets) is None:
            return None
        return F.transform(value, lambda x: _public(x, kind.elementType, secrets))
    if isinstance(kind, T.MapType):
        named = drop_forbidden(value) if isinstance(kind.keyType, T.StringType) else value
        if _public(F.lit(None).cast(kind.valueType), kind.valueType, secrets) is None:
            return None
        return F.transform_values(named, lambda _, x: _public(x, kind.valueType, secrets))
    if isinstance(kind, T.StructType):
        kept = [(f.name, _public(value.getField(f.name), f.dataType, secrets)) for f in kind if f.name.lower() not in FORBIDDEN_KEYS]
        fields = [column.alias(name) for name, column in kept if column is not None]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else None
    return value


def public_records(records: DataFrame, secrets=()) -> DataFrame:
    """Records as they may be published: the schema is walked through structs, arrays and maps, forbidden fields and
    keys go at any depth, and every text is scrubbed. It is one projection; a struct with forbidden fields only goes."""
    kept = [(f.name, _public(F.col(f"`{f.name}`"), f.dataType, secrets)) for f in records.schema if f.name.lower() not in FORBIDDEN_KEYS]
    return records.select(*(column.alias(name) for name, column in kept if column is not None))


def numbers(text: Column) -> Column:
    """Distinct numeric claims, without blanks and thousands separators."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_.])(\p{Nd}+(?:[.,]\p{Nd}+)*(?:[" + SPACES + r"]*%)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.translate(n, " ,", "")))


def public_https(url: Column) -> Column:
    """https, a host, no user information."""
    return F.coalesce(
        F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).eqNullSafe("https")
        & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0)
        & F.try_parse_url(url, F.lit("USERINFO")).isNull(), F.lit(False))
