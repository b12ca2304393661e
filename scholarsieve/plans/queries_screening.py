"""Screening and rule-laboratory queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from scholarsieve.functions.ids import fingerprint
from scholarsieve.operators import lab, rules
from scholarsieve.plans import stand_ins as s
from scholarsieve.plans.registry import query, table

_GROUPS = list(s.CORPUS["groups"])


@query(f"""
    WITH {s.PAPERS}, {s.sql_hits(s.CORPUS_RULES)}
    SELECT doc_id, {', '.join(_GROUPS)} FROM hits""")
def rule_group_hits(spark, d):
    hits = rules.group_hits(s.papers(spark, d), s.CORPUS_RULES)
    return hits.select("doc_id", *(F.col("_hits")[g].alias(g) for g in _GROUPS))


@query(f"""
    WITH {s.PAPERS}, {s.sql_matched(s.CORPUS_RULES)}
    SELECT doc_id, array_to_string(routes, ',') AS routes FROM matched""")
def rule_route_match(spark, d):
    return rules.match(s.papers(spark, d), s.CORPUS_RULES).select("doc_id", F.array_join("routes", ",").alias("routes"))


@query(f"""
    WITH {s.PAPERS}, {s.sql_matched(s.CORPUS_RULES)}
    SELECT route, count(*) AS papers FROM (SELECT unnest(routes) AS route FROM matched) GROUP BY route""")
def rule_route_counts(spark, d):
    return rules.route_counts(rules.match(s.papers(spark, d), s.CORPUS_RULES))


@query(f"""
    WITH {s.PAPERS}, {s.sql_matched(s.NARROW_RULES)}
    SELECT doc_id, array_to_string(routes, ',') AS routes FROM matched""")
def rule_category_and_exclusion(spark, d):
    return rules.match(s.papers(spark, d), s.NARROW_RULES).select("doc_id", F.array_join("routes", ",").alias("routes"))


def _trace_sql() -> str:
    rows = []
    for route, clauses in s.CORPUS["routes"].items():
        for clause in clauses:
            for group in clause:
                for phrase in s.CORPUS["groups"][group]:
                    in_a, in_t = s.sql_has("a", [phrase]), s.sql_has("t", [phrase])
                    rows.append(f"SELECT doc_id, '{route}' AS route, '{'+'.join(clause)}' AS groups, '{group}' AS \"group\", '{phrase}' AS keyword, "
                                f"concat_ws(',', CASE WHEN {in_a} THEN 'abstract' END, CASE WHEN {in_t} THEN 'title' END) AS fields "
                                f"FROM matched WHERE {' AND '.join(clause)} AND ({in_a} OR {in_t})")
    return "\n    UNION ALL ".join(rows)


@query(f"""
    WITH {s.PAPERS}, {s.sql_matched(s.CORPUS_RULES)}
    {_trace_sql()}""")
def rule_trace_explode(spark, d):
    rows = rules.trace_keywords(rules.trace(s.papers(spark, d), s.CORPUS_RULES), "doc_id")
    return rows.select("doc_id", "route", F.array_join("groups", "+").alias("groups"), "group", "keyword", F.array_join("fields", ",").alias("fields"))


def _phrases(phrases) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {s.sql_has('a', [p])} OR {s.sql_has('t', [p])} THEN '{p}' END" for p in phrases) + ")"


@query(f"""
    WITH {s.PAPERS}, {s.sql_hits(s.NARROW_RULES)}
    SELECT doc_id, category_pass, {_phrases(s.NARROW_RULES.exclude)} AS excluded_by,
           concat_ws(';', {', '.join(f"CASE WHEN {g} THEN '{g}=' || {_phrases(p)} END" for g, p in s.NARROW_RULES.groups.items())}) AS matched_groups,
           CASE WHEN category_pass AND NOT excluded THEN array_to_string({s.sql_routes(s.NARROW_RULES)}, ',') ELSE '' END AS routes
    FROM hits""")
def lab_explain(spark, d):
    groups = F.array_join(F.transform(F.map_entries("matched_groups"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return rules.explain(s.papers(spark, d), s.NARROW_RULES).select(
        "doc_id", "category_pass", F.array_join("excluded_by", ",").alias("excluded_by"), groups.alias("matched_groups"),
        F.array_join("routes", ",").alias("routes"))


@query(f"""
    WITH {s.PAPERS}, {s.sql_matched(s.NARROW_RULES)}
    SELECT base_id, version_id, title, 'https://arxiv.org/abs/' || version_id AS link,
           strftime(published + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS published_local, array_to_string(routes, ',') AS routes
    FROM matched""")
def lab_screen_snapshot(spark, d):
    rows = lab.screen_snapshot(s.papers(spark, d), s.NARROW_RULES)
    return rows.select("base_id", "version_id", "title", "link", "published_local", F.array_join("routes", ",").alias("routes"))


@query(f"""
    WITH {s.PAPERS}, {s.sql_matched(s.CORPUS_RULES, 'before')}, {s.sql_matched(s.EDITED_RULES, 'after')}
    SELECT coalesce(b.base_id, a.base_id) AS base_id,
           CASE WHEN b.base_id IS NULL THEN 'added' WHEN a.base_id IS NULL THEN 'removed' ELSE 'changed_routes' END AS change,
           array_to_string(list_sort(b.routes), ',') AS old, array_to_string(list_sort(a.routes), ',') AS new
    FROM before b FULL JOIN after a ON a.base_id = b.base_id
    WHERE b.base_id IS NULL OR a.base_id IS NULL OR list_sort(a.routes) <> list_sort(b.routes)""")
def lab_compare_rule_versions(spark, d):
    changes = lab.compare_rules(s.papers(spark, d), s.CORPUS_RULES, s.EDITED_RULES)
    return changes.select("base_id", "change", F.array_join("old", ",").alias("old"), F.array_join("new", ",").alias("new"))


_NARROW_EVENTS = ("click", "error")


@query("""
    WITH halves AS (
        SELECT event_id % 500 AS id, list_sort(list_distinct(list(event_type) FILTER (event_type IN ('click', 'error') AND user_id % 2 = 0))) AS old,
               list_sort(list_distinct(list(event_type) FILTER (event_type IN ('click', 'error') AND user_id % 2 = 1))) AS new FROM events GROUP BY 1)
    SELECT CAST(id AS VARCHAR) AS base_id, array_to_string(old, ',') AS old, array_to_string(new, ',') AS new,
           CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed_routes' END AS change
    FROM halves WHERE old IS DISTINCT FROM new""")
def lab_compare_snapshots(spark, d):
    """Two different snapshots of matches: the event types of each half of the users are the routes."""
    events = table(spark, d, "events").where(F.col("event_type").isin(*_NARROW_EVENTS))
    half = lambda n: (events.where(F.col("user_id") % 2 == n).groupBy((F.col("event_id") % 500).cast("string").alias("base_id"))
                      .agg(F.collect_set("event_type").alias("routes")))
    return lab.compare(half(0), half(1)).select("base_id", "change", F.array_join("old", ",").alias("old"), F.array_join("new", ",").alias("new"))


@query(f"""
    WITH {s.PAPERS}
    SELECT doc_id, sha256('{{"base_id":"' || base_id || '","doc_id":' || doc_id || ',"version_id":"' || version_id || '"}}') AS fingerprint
    FROM papers""")
def paper_fingerprint(spark, d):
    return s.papers(spark, d).select("doc_id", fingerprint(F.struct("base_id", "doc_id", "version_id")).alias("fingerprint"))
