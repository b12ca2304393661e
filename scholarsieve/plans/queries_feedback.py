"""Vote parsing, effective ballots, tallies and the feedback report."""
from __future__ import annotations

from pyspark.sql import functions as F

from scholarsieve.operators import feedback, rules
from scholarsieve.plans import stand_ins as s
from scholarsieve.plans.registry import query, table

_VOTES = "CASE event_type WHEN 'click' THEN 'like' WHEN 'error' THEN 'dislike' WHEN 'signup' THEN 'conflict' ELSE 'pending' END"


def _votes(spark, d):
    """Events as daily votes on documents: one per (day, document)."""
    documents = table(spark, d, "documents")
    size = documents.agg(F.max("doc_id") + 1).scalar()
    return table(spark, d, "events").withColumn("doc_id", (F.col("event_id") * 7919) % size).groupBy("doc_id", F.to_date("ts").alias("day")) \
        .agg(F.max_by(F.expr(_VOTES), "event_id").alias("vote"))


def _traced(spark, d):
    return rules.trace(s.papers(spark, d), s.CORPUS_RULES).select("doc_id", "base_id", "rule_trace")


def _ballots(spark, d):
    """Daily ballots with the rule trace frozen in."""
    return _votes(spark, d).join(_traced(spark, d), "doc_id")


def _effective(spark, d):
    """Votes reduced to the effective one before they meet the traces."""
    votes = feedback.effective_days(_votes(spark, d).withColumn("base_id", s.paper_key("doc_id")))
    rated = votes.where(F.col("vote").isin("like", "dislike")).select("doc_id", "vote")
    return _traced(spark, d).join(rated, "doc_id")


_BALLOTS = f"""{s.PAPERS}, {s.sql_matched(s.CORPUS_RULES)},
ballots AS (
    SELECT b.*, m.base_id FROM (
        SELECT (event_id * 7919) % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, ts::DATE AS day, arg_max({_VOTES}, event_id) AS vote FROM events GROUP BY 1, 2) b
    JOIN matched m USING (doc_id)),
effective AS (
    SELECT doc_id, base_id, coalesce(arg_max(vote, day) FILTER (vote <> 'pending'), 'pending') AS vote FROM ballots GROUP BY doc_id, base_id)"""


@query(f"WITH {_BALLOTS} SELECT base_id, vote FROM effective")
def effective_ballots(spark, d):
    return feedback.effective(_ballots(spark, d)).select("base_id", "vote")


def _clauses() -> str:
    rows = []
    for route, clauses in s.CORPUS["routes"].items():
        for clause in clauses:
            rows.append(f"SELECT doc_id, '{route}' AS route, '{'+'.join(sorted(clause))}' AS groups FROM matched WHERE {' AND '.join(clause)}")
    return " UNION ".join(rows)


_COUNTS = "count(*) FILTER (vote = 'like') AS \"like\", count(*) FILTER (vote = 'dislike') AS dislike"


@query(f"""
    WITH {_BALLOTS}, clauses AS ({_clauses()})
    SELECT '{s.CORPUS_RULES.fingerprint}' AS rules_fingerprint, 'matched' AS source, route, groups, {_COUNTS}
    FROM effective JOIN clauses USING (doc_id) WHERE vote IN ('like', 'dislike') GROUP BY route, groups""")
def tally_combinations(spark, d):
    counts = feedback.tally_combinations(_effective(spark, d))
    return counts.withColumn("groups", F.array_join("groups", "+"))


def _keywords() -> str:
    rows = []
    for route, clauses in s.CORPUS["routes"].items():
        for clause in clauses:
            for group in clause:
                for phrase in s.CORPUS["groups"][group]:
                    rows.append(f"SELECT doc_id, '{route}' AS route, '{'+'.join(sorted(clause))}' AS groups, '{group}' AS \"group\", '{phrase}' AS keyword FROM matched "
                                f"WHERE {' AND '.join(clause)} AND ({s.sql_has('a', [phrase])} OR {s.sql_has('t', [phrase])})")
    return " UNION ".join(rows)


@query(f"""
    WITH {_BALLOTS}, units AS ({_keywords()})
    SELECT route, groups, "group", keyword, {_COUNTS} FROM effective JOIN units USING (doc_id) WHERE vote IN ('like', 'dislike') GROUP BY ALL""")
def tally_keywords(spark, d):
    counts = feedback.tally_keywords(_effective(spark, d))
    return counts.withColumn("groups", F.array_join("groups", "+")).drop("rules_fingerprint", "source")


@query(f"WITH {_BALLOTS} SELECT count(*) FILTER (vote IN ('like', 'dislike')) AS rated_papers FROM effective")
def rated_papers(spark, d):
    return feedback.rated_papers(feedback.effective(_ballots(spark, d)))


@query(f"""
    WITH {_BALLOTS}, clauses AS ({_clauses()}), units AS ({_keywords()}),
    words AS (SELECT route, groups, "group", keyword, {_COUNTS} FROM effective JOIN units USING (doc_id) WHERE vote IN ('like', 'dislike') GROUP BY ALL),
    counts AS (SELECT route, groups, {_COUNTS} FROM effective JOIN clauses USING (doc_id) WHERE vote IN ('like', 'dislike') GROUP BY route, groups)
    SELECT 'combinations' AS part, route, replace(groups, '+', ' + ') AS combination,
           '| {s.CORPUS_RULES.fingerprint[:12]} / matched | ' || replace(route, '_', '\\_') || ' | ' || replace(groups, '+', ' + ') || ' | ' || "like" || ' | ' || dislike || ' |' AS line
    FROM counts UNION ALL
    SELECT 'keywords', route, replace(groups, '+', ' + '),
           '| {s.CORPUS_RULES.fingerprint[:12]} / matched | ' || replace(route, '_', '\\_') || ' / ' || replace(groups, '+', ' + ') || ' | ' || replace("group", '_', '\\_') || ' | ' || keyword
           || ' | ' || "like" || ' | ' || dislike || ' |' FROM words""")
def feedback_report(spark, d):
    votes = _effective(spark, d)
    lines = feedback.summary_lines(feedback.tally_combinations(votes), feedback.tally_keywords(votes))
    return lines.select("part", "route", "combination", "line")


def _issue_bodies(spark, d):
    """Documents as issue bodies: each ballot line is built from the document's number."""
    n = F.col("doc_id")
    key = s.paper_key("doc_id")
    box = lambda mark, vote: F.concat(F.lit("- ["), mark, F.lit("] choice <!-- vote:"), key, F.lit(f":{vote} -->"))
    like = box(F.when(n % 2 == 0, "x").otherwise(" "), "like")
    dislike = box(F.when(n % 3 == 0, "X").otherwise(" "), "dislike")
    doubled = F.when(n % 5 == 0, like)
    quoted = F.concat(F.lit("quote - [x] <!-- vote:"), key, F.lit(":like --> inline"))
    body = F.concat_ws("\n", "text", quoted, like, F.when(n % 7 > 0, dislike), doubled, F.lit(""))
    return table(spark, d, "documents").select(F.col("source").alias("day"), key.alias("base_id"), body.alias("body"))


@query(f"""
    SELECT {s.sql_key('doc_id')} AS base_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'invalid' WHEN doc_id % 6 = 0 THEN 'conflict'
           WHEN doc_id % 2 = 0 THEN 'like' WHEN doc_id % 3 = 0 THEN 'dislike' ELSE 'pending' END AS vote FROM documents""")
def parse_votes(spark, d):
    bodies = _issue_bodies(spark, d)
    return feedback.parse_votes(bodies, bodies.select("day", "base_id")).select("base_id", "vote")


@query(f"""
    WITH v AS (SELECT source AS day, doc_id % 12 <> 7 AS rated FROM documents),
    done AS (SELECT day, bool_and(rated) AS complete FROM v GROUP BY day),
    issues AS (SELECT source AS day, TIMESTAMP '2024-01-01' + (min(doc_id) % 30) * INTERVAL 1 DAY AS created FROM documents GROUP BY source)
    SELECT day, CASE WHEN day < 'src5' AND complete THEN 'complete' WHEN day < 'src5' AND TIMESTAMP '2024-01-20' >= created + INTERVAL 14 DAY THEN 'expired' END AS cleanup
    FROM issues JOIN done USING (day)""")
def feedback_cleanup(spark, d):
    documents = table(spark, d, "documents")
    votes = documents.select(F.col("source").alias("day"), F.when(F.col("doc_id") % 12 == 7, "pending").otherwise("like").alias("vote"))
    issues = documents.groupBy(F.col("source").alias("day")).agg(
        F.timestamp_add("DAY", F.min("doc_id") % 30, s.ntz("2024-01-01 00:00:00")).cast("timestamp_ntz").alias("created_at"))
    return feedback.issue_outcome(votes, issues, s.ntz("2024-01-20 00:00:00"), F.lit("src5"), 14).select("day", "cleanup")
