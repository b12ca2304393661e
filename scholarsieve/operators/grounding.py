"""Are quotes and numbers of decisions and summaries backed by the source text?"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scholarsieve.functions import text
from scholarsieve.operators.rules import once
from scholarsieve.schema import SUMMARY_FIELDS


# Joins the quotes of one row for folding; control characters do not fold or collapse.
_MARK = "\x01\x02\x03"


def abstract_verdicts(decisions: DataFrame) -> DataFrame:
    """Check decision quotes against the paper's own abstract; adds quotes, bad and quote_error.

    Rows: abstract, status, abstract_evidence, uncertainty. Everything a verdict needs
    is in its own row: the quotes are folded together and split again, so nothing is
    exploded, shuffled or copied per quote.
    """
    folded = decisions.withColumns({
        "_source": once(text.quote_form(F.col("abstract"))),
        "_quotes": once(text.quote_form(F.array_join("abstract_evidence", _MARK)))})
    pieces = F.transform(F.split("_quotes", _MARK, -1), lambda q: F.trim(q))
    pairs = F.arrays_zip(F.col("abstract_evidence").alias("raw"), pieces.alias("folded"))
    bad = F.filter(pairs, lambda q: (F.length(text.strip(q["raw"])) < 8) | ~F.contains(F.col("_source"), q["folded"]))
    count = F.size("abstract_evidence")
    wrong = F.when(count > 0, F.size(bad)).otherwise(0)
    error = (F.when(F.col("status").isin("select", "reject") & (count <= 0), "decision_evidence_missing")
             .when(F.col("bad") > 0, "decision_abstract_quote_unlocated")
             .when((F.col("status") == "uncertain") & (F.size("uncertainty") <= 0), "decision_uncertainty_missing"))
    return folded.withColumn("bad", wrong).withColumns({"quotes": count, "quote_error": error}).drop("_source", "_quotes")


def abstract_quotes(decisions: DataFrame) -> DataFrame:
    """Verdicts alone: base_id, status, quotes, bad, error."""
    return abstract_verdicts(decisions).select("base_id", "status", "quotes", "bad", F.col("quote_error").alias("error"))


def passages(sections: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Text per (version_id, locator): first section wins, then figure captions."""
    rows = sections.select("version_id", "locator", F.struct(F.lit(0).alias("kind"), F.col("pos")).alias("_rank"), "text")
    if figures is not None:
        rows = rows.unionByName(figures.select("version_id", "locator", F.struct(F.lit(1).alias("kind"), F.col("pos")).alias("_rank"),
                                               F.col("caption").alias("text")))
    return rows.groupBy("version_id", "locator").agg(F.min_by("text", "_rank").alias("text"))


def locate(evidence: DataFrame, sources: DataFrame, urls: DataFrame | None = None, shortest: int = 12) -> DataFrame:
    """Add `error` to evidence rows (version_id, locator, quote[, source_url]).

    An equi-join on (version_id, locator) finds the text; only then is the
    substring tested, so there is no quote x text comparison.
    """
    joined = evidence.join(sources, ["version_id", "locator"], "left")
    folded = joined.withColumns({"_text": once(text.quote_form(F.col("text"))), "_quote": once(text.quote_form(F.col("quote")))})
    missing = (F.col("_text").isNull() | (F.coalesce(F.length(text.strip(F.col("quote"))), F.lit(0)) < shortest)
               | ~F.contains(F.col("_text"), F.col("_quote")))
    error = F.when(missing, "evidence_quote_unlocated")
    if urls is not None:
        folded = folded.join(urls.select("version_id", F.col("source_url").alias("_url")), "version_id", "left")
        error = F.when(~F.col("source_url").eqNullSafe(F.col("_url")), "evidence_source_mismatch").otherwise(error)
    return folded.withColumn("error", error).drop("_text", "_quote", "_url", "text")


def unverified_numbers(claim: Column, evidence: Column) -> Column:
    """Numbers claimed but not present in the evidence."""
    return F.array_except(text.numbers(claim), text.numbers(evidence))


def _substantive() -> Column:
    """Evidence beyond the abstract: method, experiments or conclusion, and not a bare first PDF page."""
    locator = F.col("e.locator")
    abstract = locator.rlike(r"(?i)(?:^|[:>/])\s*abstract(?:$|[#:/])")
    first_page = (F.col("source_type") == "pdf") & locator.rlike(r"^pdf-page:1(?::|$)")
    accepted = (F.contains(locator, F.lit(":caption:")) | (F.coalesce("physical_page_count", F.lit(0)) == 1)
                | F.coalesce("method_on_first_page", F.lit(False)) | F.coalesce("evaluation_on_first_page", F.lit(False)))
    return F.col("e.field").isin("method", "experiments", "conclusion") & ~abstract & (~first_page | accepted)


def _quotes_for(name: str) -> Column:
    return F.transform(F.filter("summary.evidence", lambda e: e["field"] == name), lambda e: e["quote"])


def summary_errors(summaries: DataFrame, bodies: DataFrame, sources: DataFrame, require_evidence: bool = True) -> DataFrame:
    """First reason a summary is not publishable, or null, per version_id.

    `summaries`: version_id, summary. `bodies`: version_id, source_url, source_type,
    qualified and the first-page flags. `sources`: see `passages`.
    """
    base = summaries.join(bodies, "version_id", "left")
    blank = reduce(lambda a, b: a | b, (text.blank(F.col(f"summary.{f}")) for f in SUMMARY_FIELDS))
    unfit = F.when(~F.coalesce("qualified", F.lit(False)), "unqualified_fulltext").when(blank, "summary_field_missing")
    if not require_evidence:
        return base.select("version_id", F.coalesce(unfit, F.when(F.size("summary.evidence") > 0, "summary_evidence_disabled")).alias("error"))

    rows = base.select("version_id", "source_type", "physical_page_count", "method_on_first_page", "evaluation_on_first_page",
                       F.posexplode("summary.evidence").alias("pos", "e"))
    checked = locate(rows.select("version_id", "pos", F.col("e.field").alias("field"), F.col("e.locator").alias("locator"),
                                 F.col("e.quote").alias("quote"), F.col("e.source_url").alias("source_url"),
                                 _substantive().alias("substantive")), sources, bodies)
    code = F.when(~F.col("field").isin(*SUMMARY_FIELDS), "summary_evidence_schema").otherwise(F.col("error"))
    verdict = checked.groupBy("version_id").agg(F.min_by(code, F.when(code.isNotNull(), F.col("pos"))).alias("_first"),
                                                F.max("substantive").alias("_substantive"))
    claims = []
    folded = base
    for name in SUMMARY_FIELDS:
        quotes = _quotes_for(name)
        folded = folded.withColumns({f"_claim_{name}": once(text.quote_form(F.col(f"summary.{name}"))),
                                     f"_proof_{name}": once(text.quote_form(F.array_join(quotes, " ")))})
        value = F.col(f"summary.{name}")
        excused = F.contains(value, F.lit("未报告")) | F.contains(value, F.lit("未进行")) if name == "experiments" else F.lit(False)
        claims.append(F.when((F.col(f"_proof_{name}") == "") & ~excused, f"summary_{name}_ungrounded")
                      .when(F.size(unverified_numbers(F.col(f"_claim_{name}"), F.col(f"_proof_{name}"))) > 0, f"summary_{name}_number_unverified"))
    thin = F.when(~F.coalesce("_substantive", F.lit(False)), "summary_abstract_only_evidence")
    return folded.join(verdict, "version_id", "left").select("version_id", F.coalesce(unfit, F.col("_first"), *claims, thin).alias("error"))


def review_fields_error() -> Column:
    """Route-specific evidence a review must cite. Columns: status, route, fields."""
    cites = lambda name: F.array_contains("fields", name)
    return (F.when(F.size("fields") <= 0, "review_evidence_missing")
            .when((F.col("status") == "select") & (F.col("route") == "transferable_objective") & ~(cites("theory") & cites("transfer")),
                  "review_theory_transfer_evidence_missing")
            .when((F.col("status") == "select") & (F.col("route") == "general_rl") & ~cites("method"), "review_method_evidence_missing"))


def review_errors(reviews: DataFrame, sources: DataFrame, urls: DataFrame) -> DataFrame:
    """First fault of the body evidence of each review, or null.

    Reviews: base_id, version_id, status, route, review_evidence; sources as from `passages`; urls: version_id,
    source_url. A quote that cannot be located outranks a missing field. One row per review.
    """
    cited = reviews.select("base_id", "version_id", F.posexplode("review_evidence").alias("_at", "_e")).select(
        "base_id", "version_id", "_at", "_e.locator", "_e.quote", "_e.source_url")
    faults = locate(cited, sources, urls).where("error IS NOT NULL").groupBy("base_id").agg(F.min_by("error", "_at").alias("_fault"))
    # One evidence entry without a field names none.
    fields = F.transform("review_evidence", lambda e: F.coalesce(e["field"], F.lit("")))
    named = reviews.withColumn("fields", F.coalesce(fields, F.array().cast("array<string>")))
    return named.join(faults, "base_id", "left").select(
        "base_id", F.when(F.size("fields") <= 0, "review_evidence_missing").otherwise(F.coalesce("_fault", review_fields_error())).alias("error"))


# Kinds a section note may have.
NOTE_KINDS = ("method", "evaluation", "theory", "conclusion", "limitation", "background", "other")


def note_errors(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Notes (note_id, chunk_key, locator, quote, kind) must quote the chunk they were given.

    Chunk rows: chunk_key, locator, text; a locator may occur in several rows.
    """
    keyed = notes.withColumn("_quote", once(text.quote_form(F.col("quote"))))
    texts = chunks.select("chunk_key", "locator", once(text.quote_form(F.col("text"))).alias("_text"))
    length = F.length(text.strip(F.col("quote")))
    inside = F.contains(F.col("_text"), F.col("_quote")) & length.between(12, 400)
    per_note = keyed.join(texts, ["chunk_key", "locator"], "left").groupBy("note_id").agg(
        *(F.first(c).alias(c) for c in notes.columns if c != "note_id"), F.count("_text").alias("_texts"), F.max(F.coalesce(inside, F.lit(False))).alias("_inside"))
    error = (F.when(~F.col("kind").isin(*NOTE_KINDS), "section_note_schema").when(F.col("_texts") == 0, "section_note_locator")
             .when(~F.col("_inside"), "section_note_outside_chunk"))
    return per_note.select(*notes.columns, error.alias("error"))
