"""Per-paper state: eligibility, stage retries, tiers, recovery chains and gates.

Every operator is a row-wise expression or an equi-join over state tables; the
short id lists given by an operator (`promoted`, `retried`, ...) are literals.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholarsieve.functions.text import blank
from scholarsieve.schema import ROUTES

# Event kinds that count as delivered, and retryable stages.
DELIVERED_KINDS = ("normal", "promotion", "resend")
RETRY_STAGES = ("selection", "body", "review", "summary", "translation", "title_translation", "delivery")


def _in(column: str, values) -> Column:
    return F.col(column).isin(*values) if values else F.lit(False)


def _days(count: int) -> Column:
    return F.expr(f"interval {int(count)} days")


def confirmed(events: str = "events") -> Column:
    return F.exists(events, lambda e: (e["status"] == "confirmed") & e["kind"].isin(*DELIVERED_KINDS))


def confirmed_papers(events: DataFrame) -> DataFrame:
    """The same predicate over an event table."""
    return events.where((F.col("status") == "confirmed") & F.col("kind").isin(*DELIVERED_KINDS)).select("base_id").distinct()


def manual_active(now: Column) -> Column:
    return F.coalesce(now <= F.col("manual_retry_until"), F.lit(False))


def eligibility(now: Column, recovery_days: int, promoted=(), retried=()) -> Column:
    """'eligible', or the first reason that keeps a record out of this run."""
    aged = ~manual_active(now) & (now > F.col("first_discovered") + _days(recovery_days))
    skip = F.when(~_in("base_id", retried), "not_requested") if retried else F.when(F.lit(False), "")
    return (skip.when(_in("base_id", promoted), "eligible")
            .when(F.col("pending_digest").isNotNull(), "pending_delivery")
            .when(F.col("promotion_pending"), "eligible")
            .when(F.col("confirmed"), "already_confirmed")
            .when(aged & F.col("stage").isin("rejected", "delivered"), "closed")
            .when(aged, "recovery_age_exhausted")
            .when(F.col("manual_required"), "manual_recovery_required")
            .otherwise("eligible"))


def stage_gate(now: Column, stage: Column, stage_attempts: int) -> DataFrame:
    """May this stage run now? At most one recovery per UTC day after a failure."""
    spent = F.coalesce("attempts", F.lit(0)) >= stage_attempts
    same_day = F.to_date("last_failure") == F.to_date(now)
    return (F.when(spent & (stage == "title_translation"), "attempts_exhausted")
            .when(spent, "attempts_exhausted_manual_required")
            .when(same_day, "recovery_deferred_after_failure").otherwise("run"))


def stage_attempts(attempts: DataFrame) -> DataFrame:
    """Attempt log (base_id, stage, at, failed) to counters; a later success clears the failure."""
    last = F.max_by(F.when(F.col("failed"), F.col("at")), "at")
    return attempts.groupBy("base_id", "stage").agg(F.count("*").alias("attempts"), last.alias("last_failure"))


def decision_error(d: str = "decision") -> Column:
    """Why a screening decision is unusable, or null."""
    c = lambda name: F.col(f"{d}.{name}")
    flag = lambda name: F.coalesce(c(name), F.lit(False))
    flags_missing = c("rl_is_method").isNull() | c("dpo_is_method").isNull() | c("theory_evidence").isNull() | c("transfer_evidence").isNull()
    texts_missing = (c("abstract_evidence").isNull() | F.exists(c("abstract_evidence"), lambda x: x.isNull())
                     | c("uncertainty").isNull() | F.exists(c("uncertainty"), lambda x: x.isNull()))
    bare = lambda e, name: F.coalesce(e[name], F.lit("")) == ""
    selected = c("status") == "select"
    return (F.when(~F.coalesce(c("status").isin("select", "reject", "uncertain") & c("tier").isin("full", "light")
                               & c("route").isin(*ROUTES), F.lit(False)), "invalid_enum")
            .when(blank(c("reason")), "reason_missing")
            .when(flags_missing, "flags_not_boolean")
            .when(texts_missing, "evidence_not_text")
            .when(F.exists(F.coalesce(c("review_evidence"), F.array()), lambda e: bare(e, "locator") | bare(e, "quote") | bare(e, "source_url")), "invalid_review_evidence")
            .when(~F.coalesce(c("score").between(0, 100), F.lit(False)), "invalid_score")
            .when(selected & (c("route") == "irrelevant"), "irrelevant_selected")
            .when(selected & (c("route") == "general_rl") & ~(flag("rl_is_method") | flag("dpo_is_method")), "rl_method_missing")
            .when(selected & (c("route") == "transferable_objective") & ~(flag("theory_evidence") & flag("transfer_evidence")),
                  "theory_and_transfer_missing"))


def decided_tier(d: str = "decision") -> Column:
    forced = (F.col(f"{d}.status") == "select") & (F.col(f"{d}.route") == "general_reasoning")
    return F.when(forced, "light").otherwise(F.col(f"{d}.tier"))


def tier_path(promoted: Column) -> Column:
    """Which path a decided record takes, given its frozen modules."""
    plain = ~(F.array_contains("modules", "llm_summary") | F.array_contains("modules", "evidence"))
    status = F.col("status")
    return (F.when(plain & status.isin("select", "uncertain"), "translation")
            .when(status == "uncertain", "review")
            .when((status == "select") & promoted, "full")
            .when(status == "select", F.coalesce(F.nullif(F.col("intended_tier"), F.lit("translation")), F.col("tier")))
            .otherwise("rejected"))


def quota_outcome(has_slot: Column, wanted: Column, recoverable: Column) -> Column:
    """Full work beyond the quota falls to light unless it can still be recovered."""
    return (F.when(wanted != "full", wanted).when(has_slot, "full").when(recoverable, "deferred").otherwise("light_overflow"))


def translation_stage(feedback_on: bool) -> Column:
    """The translation stage a ready record still needs, or null."""
    abstract = F.array_contains("modules", "abstract_translation")
    title = F.array_contains("modules", "title_translation") | F.lit(feedback_on)
    missing = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    needed = (abstract & missing("abstract_zh")) | (title & missing("title_zh"))
    return F.when(F.col("stage").isin("ready", "summary_validated") & needed,
                  F.when(abstract, "translation").otherwise("title_translation"))


def untitled(records: DataFrame, translations: DataFrame) -> DataFrame:
    """Records still without a translated title."""
    have = translations.where(F.coalesce("title_zh", F.lit("")) != "").select("base_id")
    return records.join(have, "base_id", "left_anti")


def promotion_error(events: str = "events") -> Column:
    """Why a requested promotion must not run, or null."""
    sent = lambda tier: F.exists(events, lambda e: (e["status"] == "confirmed") & (e["tier"] == tier))
    return (F.when(F.col("stage").isNull(), "promotion_requires_existing_record")
            .when(~F.col("status").eqNullSafe("select"), "promotion_requires_selected_paper")
            .when(F.col("pending_digest").isNotNull(), "promotion_requires_no_pending_delivery")
            .when(~sent("light") | sent("full"), "promotion_requires_confirmed_light_only"))


def resend_error() -> Column:
    return (F.when(F.col("stage").isNull() | ~F.col("confirmed") | F.col("pending_digest").isNotNull(),
                   "resend_requires_confirmed_content_without_pending_delivery")
            .when((F.col("intended_tier") == "full") & ~F.col("has_summary"), "resend_requires_validated_summary"))


def retry_error(stage: Column) -> Column:
    """Why a manual retry of `stage` is refused, or null. `attempts` counts that stage."""
    reopened = F.col("promotion_pending") | F.col("resend_pending")
    title = stage == "title_translation"
    return (F.when(~stage.isin(*RETRY_STAGES), "invalid_manual_recovery_request")
            .when(F.col("stage").isNull() | (~title & F.col("confirmed") & ~reopened), "manual_recovery_requires_undelivered_existing_record")
            .when((stage == "delivery") & F.col("pending_digest").isNull(), "manual_delivery_requires_pending_snapshot")
            .when((stage != "delivery") & ~title & F.col("pending_digest").isNotNull(), "pending_delivery_must_recover_delivery_only")
            .when((stage != "delivery") & (F.coalesce("attempts", F.lit(0)) == 0) & F.col("last_failure").isNull(),
                  "manual_retry_requires_previously_attempted_stage"))


def settle_restart(events: DataFrame) -> DataFrame:
    """A send interrupted by a crash has an unknown outcome."""
    return events.withColumn("status", F.when(F.col("status") == "sending", "unknown").otherwise(F.col("status")))


def recovery(records: DataFrame, digests: DataFrame, chains: DataFrame, now: Column, run_id: str,
             chain_attempts: int, recovery_days: int) -> DataFrame:
    """Follow record -> pending digest -> delivery chain and say whether to resend."""
    d = digests.select(F.col("digest_id").alias("pending_digest"), F.col("run_id").alias("digest_run"), "chain_root")
    c = chains.select(F.col("digest_id").alias("chain"), F.col("attempts").alias("chain_tries"), F.col("created_at").alias("chain_created"))
    joined = (records.where(F.col("pending_digest").isNotNull()).join(d, "pending_digest")
              .withColumn("chain", F.coalesce("delivery_chain", "chain_root")).join(c, "chain"))
    active = manual_active(now)
    allowed = F.when(active, F.greatest(F.lit(chain_attempts), F.coalesce("manual_delivery_limit", F.lit(0)))).otherwise(F.lit(chain_attempts))
    return joined.withColumn("outcome", F.when(F.col("digest_run") == run_id, "same_run")
                             .when(F.col("chain_tries") >= allowed, "delivery_attempts_exhausted")
                             .when(~active & (now > F.col("chain_created") + _days(recovery_days)), "delivery_recovery_age_exhausted")
                             .otherwise("recover"))


def send_gate(records: DataFrame, digests: DataFrame, day: Column) -> DataFrame:
    """Once a normal digest of the day is confirmed only promoted or resent items go out."""
    sent = digests.where((F.col("day") == day) & (F.col("status") == "confirmed") & (F.col("kind") == "normal"))
    done = sent.agg(F.count("*") > 0).scalar()
    reopened = F.col("promotion_pending") | F.col("resend_pending")
    return records.withColumn("gate", F.when(F.col("recovered") | F.col("pending_digest").isNotNull(), "in_recovery")
                              .when(F.col("confirmed") & ~reopened, "already_confirmed")
                              .when(done & ~reopened, "day_already_sent")
                              .when(~F.col("stage").isin("ready", "summary_validated"), "not_ready").otherwise("send"))


def fallback_notice() -> Column:
    """What to send when a run produced no digest."""
    return (F.when(F.col("digest_sent"), "none").when((F.col("errors") > 0) & (F.col("alerts_today") == 0), "alert")
            .when((F.col("errors") == 0) & (F.col("waiting_ready") == 0) & F.col("coverage_complete") & ~F.col("manual_run"), "empty")
            .otherwise("none"))


def last_event_kind(events: DataFrame) -> DataFrame:
    """Kind of the latest event of each (paper, digest), needed when it is resent."""
    return events.groupBy("base_id", "digest_id").agg(F.max_by("kind", "at").alias("kind"))


def body_metadata(body: str = "body") -> Column:
    """Public part of a body: no text, no image paths."""
    figures = F.transform(f"{body}.figures", lambda f: F.struct(
        f["label"].alias("label"), f["locator"].alias("locator"), f["required"].alias("required"),
        (F.coalesce(f["image_path"], F.lit("")) != "").alias("rendered")))
    return F.struct(F.col(f"{body}.version_id"), F.col(f"{body}.source_url"), F.col(f"{body}.source_type"), F.col(f"{body}.quality"),
                    F.transform(f"{body}.sections", lambda s: s["locator"]).alias("locators"), figures.alias("figures"))


def run_summary(items: DataFrame) -> DataFrame:
    """Counts of one run's delivered items by tier, plus recoveries."""
    return items.groupBy("run_id").agg(
        *(F.count_if(F.col("tier") == tier).alias(tier) for tier in ("full", "light", "translation")),
        F.count_if(F.coalesce("recovery_of", F.lit("")) != "").alias("recovery"))


def alert_codes(shards: DataFrame) -> DataFrame:
    """Distinct HTTP codes of failed shards per run."""
    failed = shards.where((F.col("status") == "failed") & F.col("http_status").between(100, 599))
    return failed.groupBy("run_id").agg(F.sort_array(F.collect_set("http_status")).alias("http_codes"))
