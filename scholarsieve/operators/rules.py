"""Rule screening: configured phrase groups and AND/OR routes compiled to Columns.

Phrases never become a table joined to text (that would be a nested-loop join);
each group is one literal regular expression evaluated where the text is read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from scholarsieve.config import fingerprint
from scholarsieve.functions import text

FIELDS = ("abstract", "title")


@dataclass(frozen=True)
class RuleSet:
    categories: tuple
    title_enabled: bool
    exclude: tuple
    groups: dict
    routes: dict
    fingerprint: str

    @classmethod
    def of(cls, rules: dict) -> "RuleSet":
        return cls(tuple(rules.get("categories", ())), bool(rules.get("title_enabled", False)),
                   tuple(rules.get("exclude", ())), dict(rules["groups"]), dict(rules["routes"]), fingerprint(rules))

    @property
    def fields(self) -> tuple:
        return FIELDS if self.title_enabled else FIELDS[:1]


def once(value: Column) -> Column:
    """Evaluate a costly value once per row.

    A filter on a projected value is otherwise pushed below the projection as a
    second copy of the whole expression; a non-deterministic guard prevents it.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def folded(papers: DataFrame, rules: RuleSet) -> DataFrame:
    """Add one folded column per enabled field; fields are matched separately."""
    return papers.withColumns({f"_{f}": once(text.match_form(F.col(f))) for f in rules.fields})


def in_category(rules: RuleSet) -> Column:
    if not rules.categories:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap("categories", F.array(*map(F.lit, rules.categories))), F.lit(False))


def _in_any_field(phrases, rules: RuleSet) -> Column:
    found = F.lit(False)
    for field in rules.fields:
        found = text.has_phrase(F.coalesce(F.col(f"_{field}"), F.lit("")), phrases) | found
    return found


def _clause(clause, hits: str = "_hits") -> Column:
    met = F.lit(True)
    for group in dict.fromkeys(clause):
        met = met & F.col(hits)[group]
    return met


def group_hits(papers: DataFrame, rules: RuleSet) -> DataFrame:
    """Add `_hits`, a struct with one boolean per group."""
    each = [_in_any_field(phrases, rules).alias(name) for name, phrases in rules.groups.items()]
    return folded(papers, rules).withColumn("_hits", once(F.struct(*each)))


def _routes(rules: RuleSet) -> Column:
    named = []
    for route, clauses in rules.routes.items():
        met = F.lit(False)
        for clause in clauses:
            met = met | _clause(clause)
        named.append(F.when(met, F.lit(route)))
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def _drop_work(df: DataFrame) -> DataFrame:
    return df.drop("_hits", *(f"_{f}" for f in FIELDS))


def _matched(papers: DataFrame, rules: RuleSet) -> DataFrame:
    # The cheap category gate is its own filter, below the costly text work.
    gated = papers.where(in_category(rules)) if rules.categories else papers
    hits = group_hits(gated, rules)
    if rules.exclude:
        hits = hits.where(~_in_any_field(rules.exclude, rules))
    return hits.withColumn("routes", _routes(rules)).where(F.size("routes") > 0)


def routes_of(papers: DataFrame, rule_sets: dict[str, RuleSet]) -> DataFrame:
    """Routes of every paper under several rule sets, one column each (null where it does not match).

    Fields are folded once, and a phrase list that several sets share is tested once.
    """
    fields = tuple(f for f in FIELDS if any(f in rules.fields for rules in rule_sets.values()))
    work = papers.withColumns({f"_{f}": once(text.match_form(F.col(f))) for f in fields})
    tests: dict[tuple, tuple[str, Column]] = {}

    def tested(phrases, rules):
        key = (tuple(phrases), rules.fields)
        if key not in tests:
            tests[key] = f"t{len(tests)}", _in_any_field(phrases, rules)
        return tests[key][0]

    named = {name: ({g: tested(p, rules) for g, p in rules.groups.items()}, tested(rules.exclude, rules) if rules.exclude else None)
             for name, rules in rule_sets.items()}
    work = work.withColumn("_tests", once(F.struct(*(test.alias(label) for label, test in tests.values()))))
    for name, rules in rule_sets.items():
        groups, excluded = named[name]
        passes = in_category(rules) & (F.lit(True) if excluded is None else ~F.col("_tests")[excluded])
        found = F.array_compact(F.array(*(F.when(_any_clause(clauses, lambda g: F.col("_tests")[groups[g]]), F.lit(route)) for route, clauses in rules.routes.items())))
        work = work.withColumn(name, F.when(passes & (F.size(found) > 0), found))
    return work.drop("_tests", *(f"_{f}" for f in fields))


def _any_clause(clauses, hit) -> Column:
    met = F.lit(False)
    for clause in clauses:
        every = F.lit(True)
        for group in dict.fromkeys(clause):
            every = every & hit(group)
        met = met | every
    return met


def match(papers: DataFrame, rules: RuleSet) -> DataFrame:
    """Papers hit by at least one route, with `routes` in configured order."""
    return _drop_work(_matched(papers, rules))


def _keyword_hits(phrases, rules: RuleSet) -> Column:
    """Matched phrases of a group with their fields.

    One small expression over a literal array, not one per phrase: plans with
    hundreds of phrases stay cheap to compile. A phrase's pattern is compiled only
    where the plain substring test has already found it.
    """
    known = [(p, text.match_form_of(p)) for p in dict.fromkeys(phrases)]
    entries = F.array(*(F.struct(F.lit(p).alias("keyword"), F.lit(needle).alias("needle"), F.lit(text.phrase_pattern([p])).alias("pattern"))
                        for p, needle in known if needle))

    def located(entry):
        each = []
        for field in rules.fields:
            value = F.coalesce(F.col(f"_{field}"), F.lit(""))
            each.append(F.when(F.contains(value, entry["needle"]) & F.rlike(value, entry["pattern"]), F.lit(field)))
        return F.struct(entry["keyword"].alias("keyword"), F.array_compact(F.array(*each)).alias("fields"))

    return F.filter(F.transform(entries, located), lambda hit: F.size(hit["fields"]) > 0)


def trace(papers: DataFrame, rules: RuleSet, source: str = "matched") -> DataFrame:
    """Matched papers plus `rule_trace`: every met clause and the phrases behind it."""
    found = _matched(papers, rules)
    used = dict.fromkeys(g for clauses in rules.routes.values() for c in clauses for g in c)
    found = found.withColumns({f"_kw_{g}": once(_keyword_hits(rules.groups[g], rules)) for g in used})
    entries = []
    for route, clauses in rules.routes.items():
        for groups in dict.fromkeys(tuple(dict.fromkeys(c)) for c in clauses):
            keywords = F.create_map(*(part for g in groups for part in (F.lit(g), F.col(f"_kw_{g}"))))
            entry = F.struct(F.lit(route).alias("route"), F.array(*map(F.lit, groups)).alias("groups"), keywords.alias("keywords"))
            entries.append(F.when(_clause(groups), entry))
    full = F.struct(F.col("version_id"), F.lit(rules.fingerprint).alias("rules_fingerprint"),
                    F.lit(source).alias("source"), F.array_compact(F.array(*entries)).alias("clauses"))
    return _drop_work(found.withColumn("rule_trace", full)).drop(*(f"_kw_{g}" for g in used))


def trace_keywords(traced: DataFrame, *keep: str) -> DataFrame:
    """One row per matched keyword of every clause."""
    clauses = traced.select(*keep, "rule_trace.rules_fingerprint", "rule_trace.source",
                            F.explode("rule_trace.clauses").alias("clause"))
    groups = clauses.select(*keep, "rules_fingerprint", "source", "clause.route", "clause.groups",
                            F.explode("clause.keywords").alias("group", "hits"))
    return groups.select(*keep, "rules_fingerprint", "source", "route", "groups", "group",
                         F.inline("hits").alias("keyword", "fields"))


def explain(papers: DataFrame, rules: RuleSet) -> DataFrame:
    """Why each paper did or did not match: nothing is filtered away."""
    hits = group_hits(papers, rules)
    excluded = F.transform(_keyword_hits(rules.exclude, rules), lambda h: h["keyword"]) if rules.exclude else F.array().cast("array<string>")
    matched = F.map_from_entries(F.array_compact(F.array(*(
        F.when(F.col("_hits")[name], F.struct(F.lit(name), F.transform(_keyword_hits(phrases, rules), lambda h: h["keyword"])))
        for name, phrases in rules.groups.items()))))
    explained = hits.withColumns({"category_pass": in_category(rules), "excluded_by": once(excluded), "matched_groups": matched})
    allowed = F.col("category_pass") & (F.size("excluded_by") == 0)
    routes = F.when(allowed, _routes(rules)).otherwise(F.array().cast("array<string>"))
    return _drop_work(explained.withColumn("routes", routes))


def route_counts(matches: DataFrame) -> DataFrame:
    return (matches.select(F.explode("routes").alias("route")).groupBy("route")
            .agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "route"))
