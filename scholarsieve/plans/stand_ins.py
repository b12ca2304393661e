"""Engine inputs derived by Spark from the given tables, with the same in SQL."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scholarsieve.operators.rules import RuleSet
from scholarsieve.plans.registry import table

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_STAMP = "%Y-%m-%d %H:%M:%S.%f"


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def stamp(time) -> Column:
    return F.date_format(time, STAMP)


def paper_key(number) -> Column:
    """A valid old-style paper id for any non-negative number."""
    n = F.col(number) if isinstance(number, str) else number
    series = F.translate(F.floor(n / 10_000_000).cast("string"), "0123456789", "abcdefghij")
    return F.concat(F.lit("corpus"), series, F.lit("/"), F.lpad((n % 10_000_000).cast("string"), 7, "0"))


def sql_key(n: str) -> str:
    return (f"('corpus' || translate(CAST({n} // 10000000 AS VARCHAR), '0123456789', 'abcdefghij') || '/' || "
            f"lpad(CAST({n} % 10000000 AS VARCHAR), 7, '0'))")


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as papers: text is the abstract, language and source the categories."""
    d = table(spark, folder, "documents")
    key = paper_key("doc_id")
    return d.select(
        "doc_id", key.alias("base_id"), F.concat(key, F.lit("v"), (F.col("doc_id") % 3 + 1).cast("string")).alias("version_id"),
        F.substring_index("text", " ", 6).alias("title"), F.col("text").alias("abstract"),
        F.array("lang", "source").alias("categories"),
        F.timestamp_add("MINUTE", F.col("doc_id"), ntz("2024-01-01 00:00:00")).cast("timestamp_ntz").alias("published"))


PAPERS = f"""papers AS (
    SELECT doc_id, {sql_key('doc_id')} AS base_id, {sql_key('doc_id')} || 'v' || CAST(doc_id % 3 + 1 AS VARCHAR) AS version_id,
           array_to_string(string_split(text, ' ')[1:6], ' ') AS title, text AS abstract, [lang, source] AS categories,
           TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS published
    FROM documents)"""

_SPACE = r"\x{2010}-\x{2015}\x{2212}\x{fe58}\x{fe63}\x{ff0d}\-\s\x0b\x1c-\x1f\x{85}\p{Z}"
_BLANK = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def sql_match_form(x: str) -> str:
    """Equal to NFKC + casefold on this corpus (its only special letter is ß)."""
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[{_SPACE}]+', ' ', 'g'))"


def sql_quote_form(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[{_BLANK}]+', ' ', 'g'))"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_BLANK}]+', ' ', 'g'))"


def sql_has(folded: str, phrases) -> str:
    words = "|".join(phrases)
    return f"regexp_matches({folded}, '(^|[^\\p{{L}}\\p{{N}}_])({words})([^\\p{{L}}\\p{{N}}_]|$)')"


# Phrase groups that occur in the given corpus.
CORPUS = {
    "categories": [], "title_enabled": True, "exclude": [],
    "groups": {"DEFINITE": ["the rest", "of the", "on the"], "PLACE": ["in the", "to the"], "STATE": ["is", "was", "are"],
               "FRENCH": ["de la", "dans"], "GERMAN": ["und", "der die", "ist"]},
    "routes": {"definite_place": [["DEFINITE", "PLACE"], ["DEFINITE", "STATE"]], "state_of_place": [["PLACE", "STATE"]],
               "romance": [["FRENCH"]], "germanic": [["GERMAN", "STATE"], ["GERMAN"]]},
}
CORPUS_RULES = RuleSet.of(CORPUS)
NARROW_RULES = RuleSet.of({**CORPUS, "categories": ["en", "de"], "exclude": ["that the", "it the"]})
# The same rules after an edit: one phrase dropped, one route changed.
EDITED_RULES = RuleSet.of({**CORPUS, "groups": {**CORPUS["groups"], "DEFINITE": ["the rest", "of the"]},
                           "routes": {**CORPUS["routes"], "state_of_place": [["PLACE", "STATE", "DEFINITE"]], "germanic": []}})


def sql_hits(rules: RuleSet, name: str = "hits") -> str:
    """CTEs folding both fields and testing every group."""
    groups = ",\n           ".join(f"({sql_has('a', p)} OR {sql_has('t', p)}) AS {g}" for g, p in rules.groups.items())
    exclude = f"({sql_has('a', rules.exclude)} OR {sql_has('t', rules.exclude)})" if rules.exclude else "FALSE"
    gate = "list_has_any(categories, [" + ", ".join(f"'{c}'" for c in rules.categories) + "])" if rules.categories else "TRUE"
    return f"""{name} AS (
    SELECT *, {gate} AS category_pass, {exclude} AS excluded,
           {groups}
    FROM (SELECT *, {sql_match_form('abstract')} AS a, {sql_match_form('title')} AS t FROM papers))"""


def sql_routes(rules: RuleSet) -> str:
    """A list expression of hit routes in configured order."""
    each = []
    for route, clauses in rules.routes.items():
        met = " OR ".join("(" + " AND ".join(c) + ")" for c in clauses) or "FALSE"
        each.append(f"CASE WHEN {met} THEN '{route}' END")
    return f"list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)"


def sql_matched(rules: RuleSet, name: str = "matched") -> str:
    return f"""{sql_hits(rules, name + '_hits')},
{name} AS (SELECT * FROM (SELECT *, {sql_routes(rules)} AS routes FROM {name}_hits WHERE category_pass AND NOT excluded) WHERE len(routes) > 0)"""


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as paper versions: one paper per user, updates on the same day tie."""
    e = table(spark, folder, "events")
    key = paper_key("user_id")
    version = F.concat(key, F.lit("v"), (F.col("event_id") % 20 + 1).cast("string"))
    author = lambda n: F.concat(F.lit(f" a{n}-"), (F.col("event_id") % n).cast("string"))
    return e.select(
        key.alias("base_id"), version.alias("version_id"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"),
        F.concat_ws(" ", "event_type", "props").alias("abstract"),
        F.array("event_type", F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))).alias("categories"),
        F.col("ts").alias("published"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("updated"),
        F.transform(F.array(author(5), author(3)), lambda a: F.trim(a)).alias("authors"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("https://arxiv.org/pdf/"), version)).alias("pdf_url"),
        F.col("event_id").alias("arrival"))


VERSIONS = f"""versions AS (
    SELECT {sql_key('user_id')} AS base_id, {sql_key('user_id')} || 'v' || CAST(event_id % 20 + 1 AS VARCHAR) AS version_id,
           event_id % 20 + 1 AS number, event_type || ' ' || event_id AS title, event_type || ' ' || props AS abstract, event_type,
           [event_type, 'k' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR)] AS categories,
           ts AS published, date_trunc('day', ts) AS updated, ['a5-' || (event_id % 5), 'a3-' || (event_id % 3)] AS authors,
           CASE WHEN event_id % 4 = 0 THEN '' ELSE 'https://arxiv.org/pdf/' || {sql_key('user_id')} || 'v' || CAST(event_id % 20 + 1 AS VARCHAR) END AS pdf_url,
           event_id AS arrival
    FROM events)"""
