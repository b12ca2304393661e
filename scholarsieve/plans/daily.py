"""The daily batch as a sequence of Spark jobs over stored state tables.

Each stage reads the stored state, computes on the cluster and stores the result
before the next one starts, so no lazy plan ever spans a side effect. Model calls,
translation and delivery are adapters; attempts are durable before a call is made.
"""
from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone
from typing import Protocol
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Row, functions as F

from scholarsieve import config as settings, schema
from scholarsieve.functions import clock, text
from scholarsieve.operators import grounding, ledger, merge, ranking, render, rules, state
from scholarsieve.plans.window import collection_window, moved_cursor
from scholarsieve.sources.fixtures import Fixture
from scholarsieve.sources.sinks import Conflict, Store


class Analysis(Protocol):
    """Each method maps requested rows to (base_id, value); a missing row is a failure.

    A `usage` column (struct of prompt_tokens, completion_tokens, cached_tokens), where an adapter has one, is priced
    and stored; the cost guard reads what is stored.
    """

    def select(self, papers: DataFrame) -> DataFrame: ...
    def bodies(self, papers: DataFrame) -> DataFrame: ...
    def review(self, papers: DataFrame) -> DataFrame: ...
    def summarize(self, papers: DataFrame, evidence: bool) -> DataFrame: ...
    def translate(self, papers: DataFrame) -> DataFrame: ...


class FixtureAnalysis:
    """Scripted answers from a fixture file, joined by base id."""

    def __init__(self, fixture: Fixture):
        self.fixture = fixture

    def _lookup(self, papers: DataFrame, table: str) -> DataFrame:
        return papers.select("base_id").join(self.fixture.table(table, "value"), "base_id")

    def select(self, papers):
        return self._lookup(papers, "decisions")

    def bodies(self, papers):
        return self._lookup(papers, "bodies")

    def review(self, papers):
        scripted = self.fixture.table("reviews", "_r")
        return papers.join(scripted, "base_id", "left").select("base_id", F.coalesce("_r", "decision").alias("value"))

    def summarize(self, papers, evidence):
        found = self._lookup(papers, "summaries")
        return found if evidence else found.withColumn("value", F.col("value").withField("evidence", F.slice("value.evidence", 1, 0)))

    def translate(self, papers):
        flat = papers.select("base_id", F.col("paper.title").alias("title"), F.col("paper.abstract").alias("abstract"))
        return self.fixture.translations(flat).select("base_id", F.struct("title_zh", "abstract_zh").alias("value"))


class MockDelivery:
    def __init__(self, status: str = "confirmed"):
        self.status, self.sent = status, []

    def send(self, title: str, body: str) -> str:
        self.sent.append((title, body))
        return self.status


class DailyRun:
    """One run: collect, screen, decide, rank, translate, render, deliver."""

    def __init__(self, store: Store, config: dict, analysis: Analysis, delivery=None, now: datetime | None = None, run_id: str | None = None):
        self.store, self.config, self.analysis, self.delivery = store, config, analysis, delivery
        self.spark = store.spark
        self.rules = rules.RuleSet.of(config["rules"])
        moment = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
        self.now = clock.utc(moment)
        self.day = moment.astimezone(ZoneInfo("Asia/Shanghai")).date()
        # A run that is taken up again keeps its id, and with it what it has spent.
        self.run_id = run_id or f"{moment:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
        self.clock = time.monotonic
        self.started = self.clock()
        self.modules = settings.modules(config)
        self.calls, self.errors, self.requested = {}, [], False

    # -- state ------------------------------------------------------------
    def _papers(self) -> DataFrame:
        stored, empty = self.store.load("papers"), self.spark.createDataFrame([], schema.PAPER_STATE)
        # Columns that an older version did not store are null.
        return empty if stored is None else empty.unionByName(stored, allowMissingColumns=True)

    def _save(self, changed: DataFrame, notes: dict | None = None) -> DataFrame:
        """Add changed papers to the state; papers that stay as they are are not written."""
        columns = self.spark.createDataFrame([], schema.PAPER_STATE).schema
        return self.store.change("papers", changed.select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in columns)), "base_id", notes=notes)

    def _set(self, changes: DataFrame, **columns: Column) -> None:
        """Update the given columns of the papers named by `changes` (base_id, value, ...)."""
        if changes.isEmpty():
            return
        self._save(self._papers().join(changes, "base_id").withColumns(columns))

    def _eligible(self, promoted=()) -> DataFrame:
        seen = state.confirmed_papers(self._events()).withColumn("confirmed", F.lit(True))
        rows = self._papers().join(seen, "base_id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
        return rows.withColumn("outcome", state.eligibility(self.now, self.config["limits"]["recovery_days"], promoted))

    def _events(self) -> DataFrame:
        """Latest status of every delivery event."""
        log = self.store.log("events", schema.EVENT_LOG)
        return log.groupBy("base_id", "digest_id").agg(*(F.max_by(c, "at").alias(c) for c in ("kind", "tier", "mode", "status", "recovery_of")), F.max("at").alias("at"))

    def _digests(self) -> DataFrame:
        log = self.store.log("digests", schema.DIGEST_LOG)
        return log.groupBy("digest_id").agg(*(F.max_by(c, "at").alias(c) for c in ("run_id", "chain_root", "day", "kind", "status")), F.min("at").alias("created_at"))

    # -- guards -------------------------------------------------------------
    def _guard(self) -> str | None:
        """Why no further call may be made, or None: the run's time, and its stored costs against the cap."""
        if self.clock() - self.started >= self.config["limits"]["run_seconds"]:
            return "run_time_guard"
        cap = self.config["llm"]["max_run_cost"]
        if cap is None:
            return None
        if min(float(self.config["llm"]["pricing"][k]) for k in ("cache_hit_per_million", "cache_miss_per_million", "output_per_million")) <= 0:
            return "cost_guard_requires_verified_prices"
        spent = self.store.log("usage", schema.USAGE_LOG).where(F.col("run_id") == self.run_id)
        state_now = ledger.run_budget(spent, ["run_id"], cap).first()
        return {"usage_unknown": "run_cost_guard_usage_unknown", "cost_cap": "run_cost_guard"}.get(state_now["guard"]) if state_now else None

    def _spend(self, stage: str, answers: DataFrame) -> None:
        """Store what the calls of a stage cost; a call whose usage is unknown has no cost."""
        if "usage" in answers.columns:
            priced = answers.select("base_id", "usage.*").withColumn("cost", ledger.usage_cost(self.config["llm"]["pricing"]))
            self.store.append("usage", priced.select(F.lit(self.run_id).alias("run_id"), F.lit(stage).alias("stage"), "base_id", self.now.alias("at"), "cost"))

    # -- one stage ----------------------------------------------------------
    def _stage(self, stage: str, todo: DataFrame, call) -> DataFrame:
        """Gate, record the attempts, call, record the outcome; returns stored (base_id, value)."""
        log = self.store.log("attempts", schema.ATTEMPT_LOG).where(F.col("stage") == stage)
        # A manual retry restarts the count of its stage.
        resets = log.where("error = 'manual_reset'").groupBy("base_id").agg(F.max("at").alias("_reset"))
        log = log.where("error IS NULL OR error <> 'manual_reset'").join(resets, "base_id", "left").where("_reset IS NULL OR at >= _reset")
        counts = log.where("failed IS NULL").groupBy("base_id").agg(F.count("*").alias("attempts"))
        last = state.stage_attempts(log.where("failed IS NOT NULL")).select("base_id", "last_failure")
        gated = todo.join(counts, "base_id", "left").join(last, "base_id", "left").withColumn(
            "gate", state.stage_gate(self.now, F.lit(stage), self.config["limits"]["stage_attempts"]))
        gated = self.store.save(f"work_{stage}", gated)
        if gated.isEmpty():
            return gated.select("base_id", F.lit(None).alias("value")).limit(0)
        stop = self._guard()
        if stop is not None:
            self.errors.append(f"{stage}:{stop}")
            return gated.select("base_id", F.lit(None).alias("value")).limit(0)
        refused = {r["gate"]: r["n"] for r in gated.groupBy("gate").agg(F.count("*").alias("n")).collect()}
        self.calls[stage] = self.calls.get(stage, 0) + refused.pop("run", 0)
        self.errors += [f"{stage}:{gate}:{n}" for gate, n in refused.items()]
        admitted = gated.where("gate = 'run'")
        entry = lambda failed, error: [F.col("base_id"), F.lit(stage).alias("stage"), F.lit(self.run_id).alias("run_id"), self.now.alias("at"), failed.alias("failed"), error.alias("error")]
        self.store.append("attempts", admitted.select(*entry(F.lit(None).cast("boolean"), F.lit(None).cast("string"))))
        answers = admitted.select("base_id").join(call(admitted), "base_id", "left")
        if "error" not in answers.columns:
            answers = answers.withColumn("error", F.lit(None).cast("string"))
        answers = self.store.save(f"result_{stage}", answers.withColumn("error", F.coalesce("error", F.when(F.col("value").isNull(), f"{stage}_missing"))))
        self.store.append("attempts", answers.select(*entry(F.col("error").isNotNull(), F.col("error"))))
        self._spend(stage, answers)
        failed = answers.where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n")).collect()
        self.errors += [f"{stage}:{r['error']}:{r['n']}" for r in failed]
        if "attempts_exhausted_manual_required" in refused:
            self._set(gated.where("gate = 'attempts_exhausted_manual_required'").select("base_id"), manual_required=F.lit(True))
        return answers.where("error IS NULL").select("base_id", "value")

    def _decide(self, stage: str, todo: DataFrame, call, bodies: DataFrame | None = None) -> None:
        """Store decisions whose form holds, whose quotes are in the abstract and, given bodies, whose evidence is in the body."""
        def checked(papers):
            answers = call(papers).join(papers.select("base_id", "paper.abstract"), "base_id").withColumn("decision", F.col("value"))
            usage = [c for c in answers.columns if c == "usage"]
            rows = grounding.abstract_verdicts(answers.select("*", "decision.status", "decision.abstract_evidence", "decision.uncertainty"))
            error = F.coalesce(state.decision_error(), F.col("quote_error"))
            if bodies is not None:
                # The answers are stored, so that the evidence and the decision come from one call.
                rows = self.store.save(f"raw_{stage}", rows.select("base_id", "decision", "value", "quote_error", *usage))
                body, sources = self._sources(bodies)
                named = rows.join(body.select("base_id", "version_id"), "base_id").select("base_id", "version_id", "decision.status", "decision.route", "decision.review_evidence")
                faults = grounding.review_errors(named, sources, body.select("version_id", "source_url"))
                rows = rows.join(faults.withColumnRenamed("error", "_body_error"), "base_id", "left")
                error = F.coalesce(state.decision_error(), F.col("_body_error"), F.col("quote_error"))
            return rows.withColumn("value", F.col("value").withField("tier", state.decided_tier())).select("base_id", "value", *usage, error.alias("error"))

        answers = self._stage(stage, todo, checked)
        status = F.col("value.status")
        self._set(answers, decision=F.col("value"), stage=F.when(status == "reject", "rejected").when(status == "select", "selected").otherwise("uncertain"))

    # -- manual requests ----------------------------------------------------
    def _requested(self, ids) -> DataFrame:
        """Requested papers with their delivery history; unknown ids have a null stage."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "base_id string")
        history = self._events().groupBy("base_id").agg(F.collect_set(F.struct("status", "tier")).alias("events"))
        seen = state.confirmed_papers(self._events()).withColumn("confirmed", F.lit(True))
        rows = asked.join(self._papers(), "base_id", "left").join(history, "base_id", "left").join(seen, "base_id", "left")
        return rows.withColumns({
            "confirmed": F.coalesce("confirmed", F.lit(False)), "status": F.col("decision.status"), "has_summary": F.col("summary").isNotNull(),
            "events": F.coalesce("events", F.array().cast("array<struct<status:string,tier:string>>"))})

    @staticmethod
    def _refuse(rows: DataFrame, error: Column) -> DataFrame:
        bad = rows.select(error.alias("error")).where("error IS NOT NULL").distinct().collect()
        if bad:
            raise ValueError(",".join(sorted(r["error"] for r in bad)))
        return rows.select("base_id")

    def promote(self, ids) -> None:
        """Upgrade papers that were delivered light to a full summary."""
        self.requested = True
        accepted = self._refuse(self._requested(ids), state.promotion_error())
        self._set(accepted, intended_tier=F.lit("full"), promotion_pending=F.lit(True), manual_required=F.lit(False), stage=F.lit("selected"),
                  modules=F.array(*map(F.lit, self.modules)))

    def resend(self, ids) -> None:
        """Deliver confirmed content once more, without new model calls."""
        self.requested = True
        accepted = self._refuse(self._requested(ids), state.resend_error())
        self._set(accepted, resend_pending=F.lit(True), stage=F.when(F.col("intended_tier") == "full", "summary_validated").otherwise("ready"))

    def retry(self, stage: str, ids) -> None:
        """Give a stage of undelivered papers a fresh set of attempts for the recovery period."""
        log = self.store.log("attempts", schema.ATTEMPT_LOG).where(F.col("stage") == stage)
        tries = log.groupBy("base_id").agg(F.count("*").alias("attempts"), F.max(F.when(F.col("failed"), F.col("at"))).alias("last_failure"))
        accepted = self._refuse(self._requested(ids).join(tries, "base_id", "left"), state.retry_error(F.lit(stage)))
        accepted, self.requested = self.store.save("retried", accepted), True
        until = self.now + F.expr(f"interval {self.config['limits']['recovery_days']} days")
        limit = F.lit(self.config["delivery"]["chain_attempts"])
        if stage == "delivery":
            spent = self.store.log("digests", schema.DIGEST_LOG).where("status = 'sending'").groupBy("chain_root").agg(F.count("*").alias("n"))
            chains = accepted.join(self._papers().select("base_id", F.col("delivery_chain").alias("chain_root")), "base_id").join(spent, "chain_root", "left")
            self._set(chains.select("base_id", "n"), manual_delivery_limit=(F.coalesce("n", F.lit(0)) + limit).cast("int"))
        for name in {stage, *(("body",) if stage in ("summary", "review") else ())} - {"delivery"}:
            self.store.append("attempts", accepted.select("base_id", F.lit(name).alias("stage"), F.lit(self.run_id).alias("run_id"), self.now.alias("at"),
                                                          F.lit(None).cast("boolean").alias("failed"), F.lit("manual_reset").alias("error")))
        self._set(accepted, manual_retry_until=until, manual_required=F.lit(False))

    # -- stages -------------------------------------------------------------
    def window(self, start: str | None = None, end: str | None = None) -> Row:
        """The window to collect: automatic from the stored cursor, or a manual one. A gap is reported as an error."""
        planned = collection_window(self.spark, self.store.notes("papers"), self.now, start, end)
        if planned["gap_start"] is not None:
            self.errors.append("collection_gap_outside_lookback")
        return planned

    def collect(self, scanned: DataFrame, window: Row | None = None, complete: bool = True) -> None:
        """Screen, cap, merge and upsert; independent of everything later.

        The cursor is stored in the same pointer as the papers: both become visible together, and only a complete
        automatic window moves it. The first automatic window fixes the floor.
        """
        known = self._papers().select("base_id")
        usable, rejected = merge.split_invalid(scanned)
        rejects = self.store.save("rejects", rejected.select("version_id", "reason"))
        self.errors += [f"collection:{r['reason']}:{r['n']}" for r in rejects.groupBy("reason").agg(F.count("*").alias("n")).collect()]
        traced = merge.collect(usable, self.rules, known, self.config["collection"]["max_candidates"], again=rules.trace)
        content = ["version_id", "title", "abstract", "categories", "published", "updated", "authors", "pdf_url"]
        incoming = self.store.save("collected", traced.select("base_id", F.struct(*content).alias("paper"), "routes", "rule_trace"))
        papers = self._papers()
        merged = merge.upsert(papers.withColumn("decision_status", F.col("decision.status")), incoming.drop("rule_trace"), self.now).drop("decision_status")
        kept = [c for c in papers.columns if c not in merged.columns]
        rest = papers.select("base_id", *kept)
        fresh = incoming.select("base_id", F.col("rule_trace").alias("_trace"), F.col("paper.version_id").alias("_version"))
        # Only papers of this scan can have changed.
        joined = merged.join(incoming.select("base_id"), "base_id", "left_semi").join(rest, "base_id", "left").join(fresh, "base_id", "left")
        takes = F.col("_trace").isNotNull() & F.col("decision").isNull() & (F.col("_version") == F.col("paper.version_id"))
        flags = {c: F.coalesce(c, F.lit(False)) for c in ("promotion_pending", "resend_pending", "manual_required")}
        self._save(joined.withColumn("rule_trace", F.when(takes, F.col("_trace")).otherwise(F.col("rule_trace"))).withColumns(flags),
                   notes=moved_cursor(self.store.notes("papers"), window, complete))
        if not complete:
            self.errors.append("collection_incomplete")

    def select(self) -> None:
        todo = self._eligible().where("outcome = 'eligible' AND NOT resend_pending AND decision IS NULL")
        self._decide("selection", todo, self.analysis.select)
        aged = self._eligible().where(F.col("outcome") == "recovery_age_exhausted").select("base_id")
        self._set(aged, manual_required=F.lit(True))
        # What a record shows is frozen with its decision; later collections don't change it.
        fresh = self._papers().where("decision IS NOT NULL AND modules IS NULL").select("base_id")
        self._set(fresh, modules=F.array(*map(F.lit, self.modules)), presentation_rule_hits=F.col("rule_hits"), presentation_rule_trace=F.col("rule_trace"))

    def _routed(self, path: str) -> DataFrame:
        rows = self._eligible().where("outcome = 'eligible' AND NOT resend_pending AND decision IS NOT NULL")
        flat = rows.withColumns({"status": F.col("decision.status"), "tier": F.col("decision.tier")})
        return flat.withColumn("path", state.tier_path(F.col("promotion_pending"))).where(F.col("path") == path)

    def list_metadata(self) -> None:
        """Without full-text modules every accepted paper is listed by its metadata."""
        self._set(self._routed("translation").select("base_id"), intended_tier=F.lit("translation"), stage=F.lit("ready"))

    def _slots(self, kind: str) -> DataFrame:
        return self.store.log("slots", schema.SLOT_LOG).where((F.col("day") == F.lit(self.day)) & (F.col("kind") == kind))

    def review(self) -> None:
        """Review the best uncertain papers for the slots left today; a failure keeps its slot."""
        taken = self._slots("review")
        order = ranking.key((-F.coalesce("decision.score", F.lit(0.0))).alias("score"), "paper.version_id")
        queue = self._routed("review").join(taken.select("base_id"), "base_id", "left_anti").withColumns({"order": order, "day": F.lit(self.day)})
        picks = self.store.save("review_picks", ranking.fill_slots(queue, taken, ["day"], "order", self.config["limits"]["review_daily_limit"]).drop("rank", "order"))
        self.store.append("slots", picks.select("day", F.lit("review").alias("kind"), "base_id"))
        bodies = self._body(picks)
        self._decide("review", picks.join(bodies.select("base_id"), "base_id", "left_semi"), self.analysis.review, bodies)

    @staticmethod
    def _sources(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Bodies with their quality flags, and the passages that evidence may quote."""
        body = bodies.select("base_id", F.col("value.version_id").alias("version_id"), "value.source_url", "value.source_type", F.lit(True).alias("qualified"),
                             "value.quality.physical_page_count", *(F.coalesce(f"value.quality.{flag}", F.lit(False)).alias(flag) for flag in ("method_on_first_page", "evaluation_on_first_page")),
                             F.col("value.sections").alias("sections"), F.col("value.figures").alias("figures"))
        parts = body.select("version_id", F.posexplode("sections").alias("pos", "s")).select("version_id", "pos", "s.locator", "s.text")
        captions = body.select("version_id", F.posexplode("figures").alias("pos", "f")).select("version_id", "pos", "f.locator", "f.caption")
        return body, grounding.passages(parts, captions)

    def _body(self, papers: DataFrame) -> DataFrame:
        """Qualified full text of exactly the requested version."""
        def read(rows):
            found = self.analysis.bodies(rows).join(rows.select("base_id", F.col("paper.version_id").alias("_version")), "base_id")
            fits = F.coalesce(F.col("value.quality.passed") & (F.col("value.version_id") == F.col("_version")), F.lit(False))
            return found.select("base_id", "value", F.when(~fits, "fulltext_gate_or_version_failed").alias("error"))

        return self._stage("body", papers.drop("day"), read)

    def summarize(self) -> None:
        """Fill today's full slots in rank order; a failed summary frees its slot for the next paper.

        Every round asks for at most the free slots (10 or fewer) of the ranked queue.
        """
        limit = self.config["limits"]["full_daily_limit"]
        evidence = "evidence" in self.modules
        priority = F.array(*map(F.lit, self.config["selection"]["route_priority"]))
        place = F.array_position(priority, F.col("decision.route"))
        order = ranking.key(F.when(place == 0, 99).otherwise(place).alias("place"), (-F.coalesce("decision.score", F.lit(0.0))).alias("score"), "paper.version_id")
        ready = self._routed("full").where("summary IS NOT NULL AND promotion_pending").select("base_id")
        self._set(ready, stage=F.lit("summary_validated"))
        queue = self.store.save("full_queue", self._routed("full").where("summary IS NULL").withColumn("order", order))
        used = self._slots("full").count()
        tried = queue.select("base_id").limit(0)
        while used < limit:
            batch = self.store.save("full_batch", queue.join(tried, "base_id", "left_anti").orderBy("order").limit(limit - used))
            if batch.isEmpty():
                break
            tried = self.store.save("full_tried", tried.unionByName(batch.select("base_id")))
            bodies = self._body(batch.drop("order"))
            done = self._stage("summary", batch.drop("order").join(bodies.select("base_id"), "base_id", "left_semi"), lambda rows: self._validated(rows, bodies, evidence))
            self._set(done, summary=F.col("value"), intended_tier=F.lit("full"), stage=F.lit("summary_validated"))
            self.store.append("slots", done.select(F.lit(self.day).alias("day"), F.lit("full").alias("kind"), "base_id"))
            used += done.count()
        # Untried papers beyond the quota become light; anything with a failure or a promotion waits.
        ended = self.store.log("attempts", schema.ATTEMPT_LOG).where("failed IS NOT NULL AND stage <> 'title_translation'")
        failed = state.stage_attempts(ended).where("last_failure IS NOT NULL").select("base_id").distinct()
        overflow = queue.where("NOT promotion_pending").join(tried, "base_id", "left_anti").join(failed, "base_id", "left_anti")
        self._set(overflow.select("base_id"), intended_tier=F.lit("light"), tier_reason=F.lit("full_quota_overflow"), stage=F.lit("ready"))
        self._set(self._routed("light").select("base_id"), intended_tier=F.lit("light"), stage=F.lit("ready"))

    def _validated(self, rows: DataFrame, bodies: DataFrame, evidence: bool) -> DataFrame:
        answers = self.store.save("summaries_raw", self.analysis.summarize(rows, evidence))
        body, sources = self._sources(bodies)
        named = answers.join(body.select("base_id", "version_id"), "base_id").select("version_id", F.col("value").alias("summary"))
        verdict = grounding.summary_errors(named, body.drop("sections", "figures", "base_id"), sources, evidence)
        return answers.join(body.select("base_id", "version_id"), "base_id").join(verdict, "version_id").select("base_id", "value", "error")

    def translate(self) -> None:
        ready = self._eligible().where("outcome = 'eligible' AND NOT resend_pending").withColumn("needed", state.translation_stage(False))
        for stage in ("translation", "title_translation"):
            todo = self.store.save(f"need_{stage}", ready.where(F.col("needed") == stage).drop("needed"))
            if todo.isEmpty():
                continue
            answers = self._stage(stage, todo, self.analysis.translate)
            self._log_translation_errors(stage, todo)
            abstract = F.col("value.abstract_zh") if stage == "translation" else F.col("abstract_zh")
            self._set(answers, title_zh=F.col("value.title_zh"), abstract_zh=abstract)
            self._set(todo.join(answers, "base_id", "left_anti").select("base_id"), stage=F.lit("presentation_pending"))

    def backfill_titles(self) -> None:
        """Titles of collected papers that no stage translates, for the long-term index, where titles are translated at all.

        A run with manual requests makes no calls of its own accord; what failed in this run waits for the next.
        """
        if not self.config["presentation"]["title_translation"] or self.requested:
            return
        tried = self.store.log("attempts", schema.ATTEMPT_LOG).where((F.col("run_id") == self.run_id) & F.col("stage").isin("translation", "title_translation"))
        todo = self.store.save("need_index_titles", self._papers().where("coalesce(title_zh, '') = ''").join(tried.select("base_id").distinct(), "base_id", "left_anti"))
        if not todo.isEmpty():
            answers = self._stage("title_translation", todo, self.analysis.translate)
            self._log_translation_errors("title_translation", todo)
            self._set(answers, title_zh=F.col("value.title_zh"))

    def index(self) -> DataFrame:
        """Replace the long-term index of all collected papers: sort by (part, first_discovered, version_id), the last two descending."""
        records = self._papers().select("first_discovered", "paper.version_id", "paper.title", "title_zh")
        return self.store.save("paper_index", render.paper_index_page(records))

    def _log_translation_errors(self, stage: str, todo: DataFrame) -> None:
        """Keep failed answers, scrubbed, once for each run, stage and paper."""
        result = self.store.load(f"result_{stage}")
        if result is None:
            return
        failed = result.where("error IS NOT NULL").join(todo.select("base_id"), "base_id", "left_semi")
        response = F.when(F.col("value").isNotNull(), text.scrub(F.to_json("value")))
        rows = failed.select(F.lit(self.run_id).alias("run_id"), F.lit(stage).alias("stage"), "base_id", self.now.alias("at"), "error", response.alias("response"))
        if not rows.isEmpty():
            self.store.append_once("translation_errors", rows, schema.TRANSLATION_ERROR_LOG, "run_id", "stage", "base_id", within=F.col("run_id") == self.run_id)

    def recoveries(self) -> DataFrame:
        """Unconfirmed deliveries that may be sent again."""
        sends = self.store.log("digests", schema.DIGEST_LOG).where("status = 'sending'").groupBy("chain_root").agg(F.count("*").alias("attempts"), F.min("at").alias("created_at"))
        due = state.recovery(self._papers(), self._digests(), sends.withColumnRenamed("chain_root", "digest_id"), self.now, self.run_id,
                             self.config["delivery"]["chain_attempts"], self.config["limits"]["recovery_days"])
        spent = due.where(F.col("outcome").startswith("delivery_")).select("base_id")
        self._set(spent, manual_required=F.lit(True))
        return due.where("outcome = 'recover'").select("base_id", F.col("pending_digest").alias("recovery_of"))

    def items(self) -> DataFrame:
        due = self.store.save("recoveries", self.recoveries())
        flagged = self._eligible().join(due, "base_id", "left").withColumn("recovered", F.col("recovery_of").isNotNull())
        gated = state.send_gate(flagged, self._digests(), F.lit(self.day))
        chosen = gated.where("gate = 'send' OR recovered")
        content = ["paper.version_id", "paper.title", "paper.abstract"]
        return chosen.select("base_id", *content, "intended_tier", "summary", "title_zh", "abstract_zh", "modules", "rule_hits", "rule_trace", "presentation_rule_hits", "presentation_rule_trace",
                             "recovery_of", "first_discovered",
                             "delivery_chain", "promotion_pending", "resend_pending")

    def send(self) -> dict:
        """Render, store the archive, reserve the quota, deliver, record the outcome."""
        digest_id = self.run_id
        flat = self.items().withColumn("digest_id", F.lit(digest_id))
        staged = render.digest_items(flat).withColumn("order", ranking.key(F.col("recovery_of").isNull().alias("new"), "first_discovered", "base_id"))
        rendered = self.store.save("items", render.items(ranking.positions(staged, ["digest_id"], "order").drop("order")))
        counts = {r["tier"]: r["n"] for r in rendered.groupBy("tier").agg(F.count("*").alias("n")).collect()}
        result = {"digest_id": None, "status": "none", **{t: counts.get(t, 0) for t in ("full", "light", "translation")}}
        if not counts:
            return result
        broken = rendered.where("error IS NOT NULL").groupBy("error").count().collect()
        if broken:
            raise Conflict("unrenderable_items:" + ",".join(sorted(r["error"] for r in broken)))
        if not render.duplicate_items(rendered).isEmpty():
            raise Conflict("duplicate_digest_items")
        base = self.config["archive"]["public_base_url"].rstrip("/") or "https://example.invalid/digests"
        path = f"archive/{self.day:%Y/%m/%d}/{digest_id}"
        self.store.snapshot(path, render.archive_page(rendered, F.lit(str(self.day)), self._clean(sorted(set(self.errors)))), ["recovery", "tier_order", "part", "position"])
        url, index, cap = F.lit(f"{base}/{path}"), f"{base}/archive/papers", self.config["delivery"]["body_bytes"]
        fitted = self.store.save("notification", render.notification(rendered, url, cap, F.lit(str(self.day)), index_url=index))
        if not fitted.where("NOT fits").isEmpty():
            raise Conflict("message_metadata_exceeds_byte_cap")
        chain = rendered.select(F.coalesce("delivery_chain", F.lit(digest_id)).alias("chain_root")).distinct()
        record = lambda status, at: chain.select(F.lit(digest_id).alias("digest_id"), F.lit(self.run_id).alias("run_id"), "chain_root", F.lit(self.day).alias("day"),
                                                 F.lit("normal").alias("kind"), F.lit(status).alias("status"), at.alias("at"))
        result["digest_id"] = digest_id
        if self.delivery is None:
            return {**result, "status": "prepared"}
        units = 1 + (self.config["delivery"]["poll_limit"] if self.config["delivery"]["query_counts_quota"] else 0)
        sent = self.store.log("digests", schema.DIGEST_LOG).where((F.col("day") == F.lit(self.day)) & (F.col("status") == "sending")).select("digest_id").distinct().count()
        if (sent + 1) * units > self.config["delivery"]["daily_limit"]:
            self.errors.append("delivery_daily_quota_exhausted")
            return {**result, "status": "deferred"}
        # A recovery repeats the kind of the delivery it recovers.
        before = state.last_event_kind(self._events()).select("base_id", F.col("digest_id").alias("recovery_of"), F.col("kind").alias("_before"))
        kind = F.coalesce("_before", F.when(F.col("resend_pending"), "resend").when(F.col("promotion_pending"), "promotion").otherwise("normal"))
        modes = self.store.save("event_kinds", fitted.select("base_id", "mode").join(rendered.select("base_id", "recovery_of"), "base_id").join(before, ["base_id", "recovery_of"], "left")
                                .select("base_id", "mode", "_before"))
        event = lambda status, at: rendered.join(modes, "base_id").select("base_id", F.lit(digest_id).alias("digest_id"), kind.alias("kind"), "tier", "mode", F.lit(status).alias("status"), at.alias("at"), "recovery_of")
        self.store.append("digests", record("sending", self.now))
        self.store.append("events", event("sending", self.now))
        self._set(rendered.select("base_id"), pending_digest=F.lit(digest_id), delivery_chain=F.coalesce("delivery_chain", F.lit(digest_id)))
        outcome = self.delivery.send(f"arXiv 每日简报 {self.day}", self._message(rendered, fitted, f"{base}/{path}", index))
        status = "unknown" if outcome == "queued" else outcome
        later = self.now + F.expr("interval 1 microsecond")
        self.store.append("digests", record(status, later))
        self.store.append("events", event(status, later))
        if status == "confirmed":
            self._set(rendered.select("base_id"), pending_digest=F.lit(None), promotion_pending=F.lit(False), resend_pending=F.lit(False), stage=F.lit("delivered"))
        elif status == "failed":
            self._set(rendered.select("base_id"), stage=F.lit("delivery_failed"))
        if status != "confirmed":
            self.errors.append(f"delivery_{status}")
        return {**result, "status": status}

    def notify(self, sent: dict, complete: bool, manual: bool) -> dict:
        """Without a digest: an alert about errors, or word that there is nothing new, each at most once a day.

        The day's notice of a kind is claimed before it is sent, so concurrent or repeated runs send one.
        """
        if self.delivery is None:
            return sent
        today = self.store.log("digests", schema.DIGEST_LOG).where(F.col("day") == F.lit(self.day))
        confirmed = state.confirmed_papers(self._events())
        waiting = self._papers().where(F.col("stage").isin("ready", "summary_validated")).join(confirmed, "base_id", "left_anti").count()
        alerts = today.where("kind = 'alert'").select("digest_id").distinct().count()
        seen = self.spark.createDataFrame([(sent["digest_id"] is not None, len(set(self.errors)), alerts, waiting, complete, manual)],
                                          "digest_sent boolean, errors int, alerts_today int, waiting_ready int, coverage_complete boolean, manual_run boolean")
        kind = seen.select(state.fallback_notice().alias("kind")).first()["kind"]
        units = 1 + (self.config["delivery"]["poll_limit"] if self.config["delivery"]["query_counts_quota"] else 0)
        used = today.where("status = 'sending'").select("digest_id").distinct().count()
        if kind == "none" or (used + 1) * units > self.config["delivery"]["daily_limit"] or not self.store.claim(f"{self.day}-{kind}"):
            return sent
        digest_id = f"{self.run_id}-{kind}"
        record = lambda status, at: self.spark.range(1).select(
            F.lit(digest_id).alias("digest_id"), F.lit(self.run_id).alias("run_id"), F.lit(digest_id).alias("chain_root"), F.lit(self.day).alias("day"),
            F.lit(kind).alias("kind"), F.lit(status).alias("status"), at.alias("at"))
        self.store.append("digests", record("sending", self.now))
        outcome = self.delivery.send(f"arXiv 每日简报 {self.day}", self._notice(kind))
        status = "unknown" if outcome == "queued" else outcome
        self.store.append("digests", record(status, self.now + F.expr("interval 1 microsecond")))
        return {**sent, "digest_id": digest_id, "status": status, "delivery_kind": kind}

    def _notice(self, kind: str) -> str:
        """Text of a notice within the byte cap; error codes that don't fit are counted."""
        head = f"# arXiv 每日简报 · {self.day}\n\n"
        if kind == "empty":
            return head + "今日没有新增论文。\n"
        codes = self._clean(sorted(set(self.errors)))
        body, cap = head + "运行出现问题：\n\n", self.config["delivery"]["body_bytes"]
        for at, code in enumerate(codes):
            line, rest = f"- {code}\n", f"- … {len(codes) - at}\n"
            if len((body + line + rest).encode()) > cap:
                return body + rest
            body += line
        return body

    def _clean(self, errors: list[str]) -> list[str]:
        """Error texts without anything that looks like a credential."""
        if not errors:
            return []
        return list(self.spark.range(1).select(F.transform(F.array(*map(F.lit, errors)), lambda e: text.scrub(e)).alias("errors")).first()["errors"])

    def _message(self, rendered: DataFrame, fitted: DataFrame, url: str, index: str) -> str:
        """The message text; its size was proven to be within the byte cap (at most 32 KiB)."""
        lines = render.notification_lines(rendered, fitted, F.lit(url)).orderBy("recovery", "tier_order", "part", "position").select("recovery", "line").collect()
        head = [f"# arXiv 每日简报 · {self.day}"] + (["**补发：上一轮投递未确认，本次可能重复。**"] if any(r["recovery"] for r in lines) else [])
        return "\n\n".join([*head, *(r["line"] for r in lines), f"[完整日报与长期存档]({url})", f"[论文长期索引]({index})"]).rstrip() + "\n"

    def _report(self, report: dict) -> dict:
        """Store the run's report; its error texts lose anything that looks like a credential."""
        report = {**report, "errors": self._clean(report["errors"])}
        self.store.report(f"reports/{self.run_id}.json", report)
        return report

    def run(self, scanned: DataFrame, coverage_complete: bool = True, window: Row | None = None) -> dict:
        """One run over scanned papers; `window` is the one they come from, if the run is to move the cursor."""
        self.store.lock()
        report = {"run_id": self.run_id, "day": str(self.day), "coverage_complete": coverage_complete, "config_fingerprint": settings.fingerprint(self.config)}
        try:
            self.collect(scanned, window, coverage_complete)
            self.select()
            self.list_metadata()
            if {"llm_summary", "evidence"} & set(self.modules):
                self.review()
                self.summarize()
            self.translate()
            self.backfill_titles()
            self.index()
            sent = self.send()
            sent = {"delivery_kind": "digest" if sent["digest_id"] else "none", **sent}
            sent = self.notify(sent, coverage_complete, manual=self.requested or (window is not None and window["manual"]))
            self.store.compact("papers")
            return self._report({**report, "records": self._papers().count(), "calls": self.calls, "errors": sorted(set(self.errors)), **sent})
        except Exception as exc:
            self._report({**report, "calls": self.calls, "errors": sorted({*self.errors, f"{type(exc).__name__}: {exc}"[:500]}), "status": "run_failed"})
            raise
        finally:
            self.store.unlock()
