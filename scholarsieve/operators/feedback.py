"""Reader votes: ballot parsing, effective votes and tallies per rule and keyword."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholarsieve.functions.text import SPACES, markdown_text

# A ballot is a check box line that ends in its vote marker.
_BALLOT = (rf"(?dm)^[{SPACES}]*- \[([ xX])\] [^\r\n]*<!-- vote:([^\s:]+):(like|dislike) -->[{SPACES}]*$")


def ballot_lines(bodies: DataFrame) -> DataFrame:
    """All marked check boxes in issue bodies (day, body)."""
    parts = [F.regexp_extract_all("body", F.lit(_BALLOT), F.lit(i)) for i in (1, 2, 3)]
    return bodies.select("day", F.inline(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("mark", "base_id", "vote"))))))


def parse_votes(bodies: DataFrame, expected: DataFrame) -> DataFrame:
    """Vote of every expected (day, base_id): exactly one box of each kind, else invalid."""
    like, checked = F.col("vote") == "like", F.lower("mark") == "x"
    boxes = ballot_lines(bodies).groupBy("day", "base_id").agg(
        F.count_if(like).alias("likes"), F.count_if(~like).alias("dislikes"),
        F.count_if(like & checked).alias("liked"), F.count_if(~like & checked).alias("disliked"))
    one_each = (F.col("likes") == 1) & (F.col("dislikes") == 1)
    vote = (F.when(~F.coalesce(one_each, F.lit(False)), "invalid").when((F.col("liked") == 1) & (F.col("disliked") == 1), "conflict")
            .when(F.col("liked") == 1, "like").when(F.col("disliked") == 1, "dislike").otherwise("pending"))
    return expected.join(boxes, ["day", "base_id"], "left").select(*expected.columns, vote.alias("vote"))


def effective(ballots: DataFrame) -> DataFrame:
    """Latest explicit vote per paper; a pending ballot never erases one."""
    row = F.struct("vote", "rule_trace")
    explicit = F.max_by(row, F.when(F.col("vote") != "pending", F.col("day")))
    best = ballots.groupBy("base_id").agg(F.coalesce(explicit, F.min_by(row, "day")).alias("_b"))
    return best.select("base_id", "_b.vote", "_b.rule_trace")


def effective_days(votes: DataFrame) -> DataFrame:
    """(base_id, day, vote) that counts for each paper, from narrow ballots without traces.

    Nothing but ids, days and votes is shuffled; join the frozen trace of that day afterwards,
    for the votes that need it.
    """
    explicit = F.max(F.when(F.col("vote") != "pending", F.col("day")))
    best = votes.groupBy("base_id").agg(F.coalesce(explicit, F.min("day")).alias("day"))
    return votes.join(best, ["base_id", "day"])


def _rated(votes: DataFrame) -> DataFrame:
    return votes.where(F.col("vote").isin("like", "dislike"))


def _context(clause: Column) -> tuple:
    return clause["route"].alias("route"), F.array_sort(clause["groups"]).alias("groups")


def _tally(rated: DataFrame, units: Column, *extra: str) -> DataFrame:
    """Count votes per unit; each paper is reduced to distinct units in its own row."""
    rows = rated.select("vote", "rule_trace.rules_fingerprint", "rule_trace.source", F.inline(F.array_distinct(units)))
    return rows.groupBy("rules_fingerprint", "source", "route", "groups", *extra).agg(
        F.count_if(F.col("vote") == "like").alias("like"), F.count_if(F.col("vote") == "dislike").alias("dislike"))


def tally_combinations(votes: DataFrame) -> DataFrame:
    return _tally(_rated(votes), F.transform("rule_trace.clauses", lambda c: F.struct(*_context(c))))


def tally_keywords(votes: DataFrame) -> DataFrame:
    def of_group(clause, entry):
        return F.transform(entry["value"], lambda hit: F.struct(
            *_context(clause), entry["key"].alias("group"), hit["keyword"].alias("keyword")))

    units = F.flatten(F.transform("rule_trace.clauses", lambda c: F.flatten(
        F.transform(F.map_entries(c["keywords"]), lambda e: of_group(c, e)))))
    return _tally(_rated(votes), units, "group", "keyword")


def rated_papers(votes: DataFrame) -> DataFrame:
    return votes.agg(F.count_if(F.col("vote").isin("like", "dislike")).alias("rated_papers"))


def issue_outcome(votes: DataFrame, issues: DataFrame, now: Column, today: Column, max_wait_days: int) -> DataFrame:
    """Close an issue of an earlier day when all its papers are rated or it is too old."""
    done = votes.groupBy("day").agg(F.every(F.col("vote").isin("like", "dislike")).alias("complete"))
    complete = F.coalesce("complete", F.lit(False))
    expired = now >= F.col("created_at") + F.expr(f"interval {int(max_wait_days)} days")
    return issues.join(done, "day", "left").withColumn("complete", complete).withColumn(
        "cleanup", F.when((F.col("day") < today) & F.col("complete"), "complete").when((F.col("day") < today) & expired, "expired"))


def summary_lines(combinations: DataFrame, keywords: DataFrame) -> DataFrame:
    """Table rows of the public feedback report, as (part, sort keys, line)."""
    head = F.concat(F.substring("rules_fingerprint", 1, 12), F.lit(" / "), F.col("source"))
    joined = F.array_join("groups", " + ")

    def row(*cells):
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    first = combinations.select(F.lit("combinations").alias("part"), "route", joined.alias("combination"), F.lit("").alias("unit"),
                                row(head, markdown_text(F.col("route")), markdown_text(joined), F.col("like"), F.col("dislike")).alias("line"))
    context = F.concat(F.col("route"), F.lit(" / "), joined)
    second = keywords.select(F.lit("keywords").alias("part"), "route", joined.alias("combination"),
                             F.concat_ws("\t", "group", "keyword").alias("unit"),
                             row(head, markdown_text(context), markdown_text(F.col("group")), markdown_text(F.col("keyword")),
                                 F.col("like"), F.col("dislike")).alias("line"))
    return first.unionByName(second)


def issue_block(prefix: str = "digest") -> Column:
    """Text block of one paper in a vote issue; `prefix` names the deployment's markers."""
    key = F.col("base_id")
    box = lambda mark, label, vote: F.concat(F.lit(f"- [ ] {mark} {label} <!-- vote:"), key, F.lit(f":{vote} -->"))
    return F.concat_ws("\n\n", F.concat(F.lit(f"<!-- {prefix}-paper:"), key, F.lit(" -->")),
                       F.concat(F.lit("### "), markdown_text(F.col("title_zh"))), markdown_text(F.col("title")),
                       F.concat(F.lit("[arXiv "), key, F.lit("]("), F.col("url"), F.lit(")")),
                       F.concat_ws("\n", box("👍", "对我有用", "like"), box("👎", "对我无用", "dislike")))


def find_issues(issues: DataFrame, days: DataFrame, author: str, prefix: str = "digest") -> DataFrame:
    """Body of each day's issue: the lowest-numbered one by the trusted author that holds
    the day's marker. Issues: number, author, body."""
    marked = issues.where(F.col("author") == author).withColumn("day", F.regexp_extract("body", rf"<!-- {prefix}-feedback:([0-9-]+) -->", 1))
    first = marked.groupBy("day").agg(F.min("number").alias("number"), F.min_by("body", "number").alias("body"))
    return days.join(first, "day", "left")
