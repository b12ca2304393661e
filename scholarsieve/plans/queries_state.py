"""Paper-state queries: eligibility, retries, tiers, recovery and gates."""
from __future__ import annotations

from pyspark.sql import functions as F

from scholarsieve.functions import delivery
from scholarsieve.operators import state
from scholarsieve.plans import stand_ins as s
from scholarsieve.plans.registry import query, table

_NOW = "1999-01-31 12:00:00"
_PROMOTED, _RETRY = (7, 11), "summary"


def _events(spark, d):
    """Line items as delivery events of their order."""
    rows = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "normal").when(F.col("l_returnflag") == "R", "promotion").otherwise("notice")
    return rows.select(F.col("l_orderkey").alias("base_id"), kind.alias("kind"), (F.col("l_suppkey") % 3).cast("string").alias("digest_id"),
                       F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("sending").alias("status"),
                       F.when(F.col("l_linenumber") % 2 == 0, "light").otherwise("full").alias("tier"),
                       F.struct("l_shipdate", "l_partkey", "l_linenumber", "l_extendedprice").alias("at"))


_EVENTS = """events_of AS (
    SELECT l_orderkey AS base_id, CASE l_returnflag WHEN 'A' THEN 'normal' WHEN 'R' THEN 'promotion' ELSE 'notice' END AS kind,
           CAST(l_suppkey % 3 AS VARCHAR) AS digest_id, CASE WHEN l_linestatus = 'F' THEN 'confirmed' ELSE 'sending' END AS status,
           CASE WHEN l_linenumber % 2 = 0 THEN 'light' ELSE 'full' END AS tier, l_shipdate, l_partkey, l_linenumber, l_extendedprice
    FROM lineitem),
confirmed AS (SELECT DISTINCT base_id FROM events_of WHERE status = 'confirmed' AND kind IN ('normal', 'promotion', 'resend'))"""


def _records(spark, d):
    """Orders as paper records; customer numbers decide the flags."""
    c = F.col("o_custkey")
    stages = F.array(*map(F.lit, ("candidate", "selected", "rejected", "ready", "summary_validated", "delivered")))
    modules = F.when(c % 3 == 0, F.array(F.lit("title"), F.lit("llm_summary"))).when(c % 3 == 1, F.array(F.lit("title"), F.lit("title_translation"))) \
        .otherwise(F.array(F.lit("title"), F.lit("abstract_translation")))
    records = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("base_id"), F.timestamp_add("DAY", F.col("o_orderkey") % 31, s.ntz("1999-01-01 00:00:00")).cast("timestamp_ntz").alias("first_discovered"),
        F.element_at(stages, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("stage"),
        F.when(c % 17 == 0, F.concat(F.lit("d"), c.cast("string"))).alias("pending_digest"),
        F.when(c % 34 == 0, F.concat(F.lit("d"), F.floor(c / 2).cast("string"))).alias("delivery_chain"),
        (c % 19 == 0).alias("promotion_pending"), (c % 23 == 0).alias("resend_pending"), (c % 11 == 0).alias("manual_required"),
        F.when(c % 13 == 0, s.ntz("1999-02-02 00:00:00")).alias("manual_retry_until"), F.when(c % 26 == 0, 5).alias("manual_delivery_limit"),
        F.element_at(F.array(F.lit("select"), F.lit("uncertain"), F.lit("reject")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("status"),
        F.when(c % 2 == 0, "full").otherwise("light").alias("tier"), F.when(c % 5 == 0, "translation").when(c % 5 == 1, "full").alias("intended_tier"),
        (c % 7 == 0).alias("has_summary"), (c % 29 == 0).alias("recovered"), modules.alias("modules"),
        F.when(c % 4 == 0, "题").alias("title_zh"), F.when(c % 8 == 0, "要").alias("abstract_zh"))
    seen = state.confirmed_papers(_events(spark, d)).withColumn("confirmed", F.lit(True))
    return records.join(seen, "base_id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


_RECORDS = f"""{_EVENTS},
records AS (
    SELECT o_orderkey AS base_id, TIMESTAMP '1999-01-01' + (o_orderkey % 31) * INTERVAL 1 DAY AS first_discovered, TIMESTAMP '{_NOW}' AS now_,
           ['candidate', 'selected', 'rejected', 'ready', 'summary_validated', 'delivered'][o_orderkey % 6 + 1] AS stage,
           CASE WHEN o_custkey % 17 = 0 THEN 'd' || o_custkey END AS pending, CASE WHEN o_custkey % 34 = 0 THEN 'd' || (o_custkey // 2) END AS delivery_chain,
           o_custkey % 19 = 0 AS promoting, o_custkey % 23 = 0 AS resending, o_custkey % 11 = 0 AS manual, o_custkey % 13 = 0 AS manual_open,
           CASE WHEN o_custkey % 26 = 0 THEN 5 ELSE 0 END AS manual_limit, ['select', 'uncertain', 'reject'][o_orderkey % 3 + 1] AS status,
           CASE WHEN o_custkey % 2 = 0 THEN 'full' ELSE 'light' END AS tier, CASE o_custkey % 5 WHEN 0 THEN 'translation' WHEN 1 THEN 'full' END AS intended_tier,
           o_custkey % 7 = 0 AS has_summary, o_custkey % 29 = 0 AS recovered, o_custkey % 3 AS module_kind, o_custkey % 4 = 0 AS has_title, o_custkey % 8 = 0 AS has_abstract,
           o_orderkey IN (SELECT base_id FROM confirmed) AS confirmed
    FROM orders)"""


@query(f"""
    WITH {_RECORDS}
    SELECT base_id, CASE WHEN base_id IN {_PROMOTED} THEN 'eligible' WHEN pending IS NOT NULL THEN 'pending_delivery' WHEN promoting THEN 'eligible'
           WHEN confirmed THEN 'already_confirmed'
           WHEN NOT manual_open AND now_ - first_discovered > INTERVAL 14 DAY THEN CASE WHEN stage IN ('rejected', 'delivered') THEN 'closed' ELSE 'recovery_age_exhausted' END
           WHEN manual THEN 'manual_recovery_required' ELSE 'eligible' END AS outcome FROM records""")
def eligibility_flags(spark, d):
    return _records(spark, d).select("base_id", state.eligibility(s.ntz(_NOW), 14, promoted=_PROMOTED).alias("outcome"))


@query(f"WITH {_EVENTS} SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT base_id FROM confirmed)")
def confirmed_semi(spark, d):
    seen = state.confirmed_papers(_events(spark, d))
    return table(spark, d, "orders").join(seen, F.col("o_orderkey") == F.col("base_id"), "left_semi").select("o_orderkey")


@query(f"""
    WITH {_RECORDS}
    SELECT base_id, CASE WHEN module_kind > 0 AND status IN ('select', 'uncertain') THEN 'translation' WHEN status = 'uncertain' THEN 'review'
           WHEN status = 'select' AND promoting THEN 'full'
           WHEN status = 'select' THEN CASE WHEN intended_tier = 'full' THEN 'full' ELSE tier END ELSE 'rejected' END AS path FROM records""")
def tier_assignment(spark, d):
    return _records(spark, d).select("base_id", state.tier_path(F.col("promotion_pending")).alias("path"))


@query(f"""
    WITH {_RECORDS}
    SELECT base_id, CASE WHEN module_kind = 2 THEN 'translation' ELSE 'title_translation' END AS stage FROM records
    WHERE stage IN ('ready', 'summary_validated') AND ((module_kind = 2 AND NOT has_abstract) OR (module_kind = 1 AND NOT has_title))""")
def translation_needed(spark, d):
    needed = _records(spark, d).withColumn("needed", state.translation_stage(False)).where("needed IS NOT NULL")
    return needed.select("base_id", F.col("needed").alias("stage"))


@query(f"WITH {_RECORDS} SELECT base_id FROM records WHERE NOT has_title")
def title_backfill(spark, d):
    records = _records(spark, d)
    return state.untitled(records, records.select("base_id", "title_zh")).select("base_id")


@query(f"""
    WITH {_RECORDS},
    sent AS (SELECT base_id, bool_or(status = 'confirmed' AND tier = 'light') AS light, bool_or(status = 'confirmed' AND tier = 'full') AS full_ FROM events_of GROUP BY base_id)
    SELECT base_id, CASE WHEN r.status <> 'select' THEN 'promotion_requires_selected_paper' WHEN pending IS NOT NULL THEN 'promotion_requires_no_pending_delivery'
           WHEN NOT coalesce(light, FALSE) OR coalesce(full_, FALSE) THEN 'promotion_requires_confirmed_light_only' END AS promotion,
           CASE WHEN NOT confirmed OR pending IS NOT NULL THEN 'resend_requires_confirmed_content_without_pending_delivery'
           WHEN intended_tier = 'full' AND NOT has_summary THEN 'resend_requires_validated_summary' END AS resend
    FROM records r LEFT JOIN sent USING (base_id)""")
def promotion_and_resend(spark, d):
    # Which tiers were confirmed is at most two distinct pairs per paper.
    tiers = _events(spark, d).groupBy("base_id").agg(F.collect_set(F.struct("status", "tier")).alias("events"))
    records = _records(spark, d).join(tiers, "base_id", "left").withColumn("events", F.coalesce("events", F.array().cast("array<struct<status:string,tier:string>>")))
    return records.select("base_id", state.promotion_error().alias("promotion"), state.resend_error().alias("resend"))


_ATTEMPTS = """attempts AS (
    SELECT user_id AS base_id, event_type AS stage, count(*) AS attempts, max(ts) AS latest,
           CASE WHEN arg_max(value, ts) < 60 THEN max(ts) END AS last_failure FROM events GROUP BY ALL)"""


def _attempts(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("base_id"), F.col("event_type").alias("stage"), F.col("ts").alias("at"), (F.col("value") < 60).alias("failed"))
    return state.stage_attempts(log)


@query(f"""
    WITH {_ATTEMPTS}
    SELECT base_id, stage, attempts, CASE WHEN attempts >= 14 THEN CASE WHEN stage = 'view' THEN 'attempts_exhausted' ELSE 'attempts_exhausted_manual_required' END
           WHEN last_failure::DATE = DATE '2024-01-30' THEN 'recovery_deferred_after_failure' ELSE 'run' END AS gate FROM attempts""")
def stage_retry_state(spark, d):
    stage = F.when(F.col("stage") == "view", "title_translation").otherwise(F.col("stage"))
    return _attempts(spark, d).select("base_id", "stage", "attempts", state.stage_gate(s.ntz("2024-01-30 18:00:00"), stage, 14).alias("gate"))


@query(f"""
    WITH {_RECORDS},
    tries AS (SELECT user_id AS key, count(*) AS attempts, max(ts) AS last_failure FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT base_id, CASE WHEN confirmed AND NOT (promoting OR resending) THEN 'manual_recovery_requires_undelivered_existing_record'
           WHEN pending IS NOT NULL THEN 'pending_delivery_must_recover_delivery_only'
           WHEN tries.key IS NULL THEN 'manual_retry_requires_previously_attempted_stage' END AS error
    FROM records LEFT JOIN tries ON tries.key = base_id""")
def manual_retry_check(spark, d):
    tries = table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("base_id")).agg(
        F.count("*").alias("attempts"), F.max("ts").alias("last_failure"))
    return _records(spark, d).join(tries, "base_id", "left").select("base_id", state.retry_error(F.lit(_RETRY)).alias("error"))


@query(f"WITH {_EVENTS} SELECT base_id, CASE WHEN status = 'sending' THEN 'unknown' ELSE status END AS status, count(*) AS n FROM events_of GROUP BY ALL")
def restart_unknown(spark, d):
    return state.settle_restart(_events(spark, d)).groupBy("base_id", "status").agg(F.count("*").alias("n"))


@query(f"""
    WITH {_EVENTS} SELECT base_id, digest_id, arg_max(kind, (l_shipdate, l_partkey, l_linenumber, l_extendedprice)) AS kind FROM events_of GROUP BY ALL""")
def previous_event_kind(spark, d):
    return state.last_event_kind(_events(spark, d))


def _digests(spark, d):
    """Customers as digests and, with their balances, as delivery chains."""
    c = table(spark, d, "customer")
    name = F.concat(F.lit("d"), F.col("c_custkey").cast("string"))
    digests = c.select(name.alias("digest_id"), F.when(F.col("c_custkey") % 10 == 0, "now").otherwise("old").alias("run_id"),
                       F.concat(F.lit("d"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("chain_root"))
    chains = c.select(name.alias("digest_id"), (F.col("c_nationkey") % 5).alias("attempts"),
                      F.timestamp_add("DAY", F.col("c_custkey") % 25, s.ntz("1999-01-05 00:00:00")).cast("timestamp_ntz").alias("created_at"))
    return digests, chains


@query(f"""
    WITH {_RECORDS},
    digests AS (SELECT 'd' || c_custkey AS id, c_custkey % 10 = 0 AS same_run, 'd' || (c_custkey // 3) AS root FROM customer),
    chains AS (SELECT 'd' || c_custkey AS id, c_nationkey % 5 AS tries, TIMESTAMP '1999-01-05' + (c_custkey % 25) * INTERVAL 1 DAY AS created FROM customer)
    SELECT base_id, CASE WHEN same_run THEN 'same_run' WHEN tries >= CASE WHEN manual_open THEN greatest(3, manual_limit) ELSE 3 END THEN 'delivery_attempts_exhausted'
           WHEN NOT manual_open AND now_ - created > INTERVAL 14 DAY THEN 'delivery_recovery_age_exhausted' ELSE 'recover' END AS outcome
    FROM records JOIN digests ON digests.id = pending JOIN chains ON chains.id = coalesce(delivery_chain, root)""")
def recovery_chain(spark, d):
    digests, chains = _digests(spark, d)
    return state.recovery(_records(spark, d), digests, chains, s.ntz(_NOW), "now", chain_attempts=3, recovery_days=14).select("base_id", "outcome")


@query(f"""
    WITH {_RECORDS}
    SELECT base_id, CASE WHEN recovered OR pending IS NOT NULL THEN 'in_recovery' WHEN confirmed AND NOT (promoting OR resending) THEN 'already_confirmed'
           WHEN (SELECT count(*) > 0 FROM events WHERE ts::DATE = DATE '2024-01-10' AND event_type = 'purchase') AND NOT (promoting OR resending) THEN 'day_already_sent'
           WHEN stage NOT IN ('ready', 'summary_validated') THEN 'not_ready' ELSE 'send' END AS gate FROM records""")
def daily_send_gate(spark, d):
    digests = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.lit("confirmed").alias("status"),
                                               F.when(F.col("event_type") == "purchase", "normal").otherwise("alert").alias("kind"))
    return state.send_gate(_records(spark, d), digests, F.lit("2024-01-10").cast("date")).select("base_id", "gate")


@query("""
    WITH runs AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 150) AS errors, count(*) FILTER (event_type = 'signup' AND value > 200) AS alerts,
                         count(*) FILTER (event_type = 'view' AND value > 120) AS waiting, user_id % 7 = 0 AS sent, user_id % 5 > 0 AS complete, user_id % 11 = 0 AS manual
                  FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN sent THEN 'none' WHEN errors > 0 AND alerts = 0 THEN 'alert'
           WHEN errors = 0 AND waiting = 0 AND complete AND NOT manual THEN 'empty' ELSE 'none' END AS notice FROM runs""")
def fallback_notice(spark, d):
    runs = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 150)).alias("errors"),
        F.count_if((F.col("event_type") == "signup") & (F.col("value") > 200)).alias("alerts_today"),
        F.count_if((F.col("event_type") == "view") & (F.col("value") > 120)).alias("waiting_ready"))
    u = F.col("user_id")
    runs = runs.withColumns({"digest_sent": u % 7 == 0, "coverage_complete": u % 5 > 0, "manual_run": u % 11 == 0})
    return runs.select("user_id", state.fallback_notice().alias("notice"))


@query("""
    SELECT strftime(l_shipdate, '%Y-%m') AS run_id, count(*) FILTER (l_returnflag = 'A') AS "full", count(*) FILTER (l_returnflag = 'R') AS light,
           count(*) FILTER (l_returnflag = 'N') AS translation, count(*) FILTER (l_linestatus = 'O') AS recovery FROM lineitem GROUP BY 1""")
def run_summary(spark, d):
    tier = F.when(F.col("l_returnflag") == "A", "full").when(F.col("l_returnflag") == "R", "light").otherwise("translation")
    items = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("run_id"), tier.alias("tier"),
                                               F.when(F.col("l_linestatus") == "O", "d1").alias("recovery_of"))
    return state.run_summary(items)


@query("""
    SELECT user_id AS run_id, string_agg(code, ',' ORDER BY code) AS http_codes FROM (
        SELECT DISTINCT user_id, CAST(400 + event_id % 7 AS VARCHAR) AS code FROM events WHERE event_type = 'error' AND event_id % 2 = 0) GROUP BY user_id""")
def alert_http_codes(spark, d):
    shards = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("status"),
        F.when(F.col("event_id") % 2 == 0, 400 + F.col("event_id") % 7).alias("http_status"))
    return state.alert_codes(shards).select("run_id", F.array_join(F.transform("http_codes", lambda c: c.cast("string")), ",").alias("http_codes"))


@query("""
    WITH x AS (SELECT doc_id, quality, toxic, doc_id % 9 AS k FROM labels)
    SELECT doc_id, CASE WHEN k = 0 THEN 'invalid_enum' WHEN k = 1 THEN 'reason_missing' WHEN k = 2 THEN 'invalid_score' WHEN k = 3 THEN 'flags_not_boolean'
           WHEN k = 4 AND quality = 1 THEN 'irrelevant_selected' WHEN k = 5 AND quality = 1 AND toxic = 0 THEN 'rl_method_missing'
           WHEN k = 6 AND quality = 1 AND toxic = 0 THEN 'theory_and_transfer_missing' WHEN k = 8 THEN 'invalid_review_evidence' END AS error,
           CASE WHEN k = 7 AND quality = 1 THEN 'light' ELSE 'full' END AS tier FROM x""")
def decision_validity(spark, d):
    k, good, bad = F.col("doc_id") % 9, F.col("quality") == 1, F.col("toxic") == 1
    route = F.when(k == 4, "irrelevant").when(k == 5, "general_rl").when(k == 6, "transferable_objective").when(k == 7, "general_reasoning").otherwise("medical_reasoning")
    evidence = F.array(F.struct(F.lit("method").alias("field"), F.lit("section:Method").alias("locator"), F.when(k == 8, "").otherwise("quoted").alias("quote"),
                                F.lit("https://example.com").alias("source_url")))
    decision = F.struct(
        F.when(k == 0, "maybe").when(good, "select").otherwise("reject").alias("status"), route.alias("route"), F.lit("full").alias("tier"),
        F.when(k == 1, " ").otherwise("because").alias("reason"), F.array(F.lit("q")).alias("abstract_evidence"), F.array(F.lit("u")).alias("uncertainty"),
        bad.alias("rl_is_method"), F.lit(False).alias("dpo_is_method"), F.when(k != 3, bad).alias("theory_evidence"), bad.alias("transfer_evidence"),
        F.when(k == 2, 101.0).otherwise(50.0).alias("score"), evidence.alias("review_evidence"))
    rows = table(spark, d, "labels").withColumn("decision", decision)
    return rows.select("doc_id", state.decision_error().alias("error"), state.decided_tier().alias("tier"))


@query("""
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'failed' WHEN 6 THEN 'queued' ELSE 'unknown' END AS status,
           CASE event_id % 7 WHEN 1 THEN 'confirmed' WHEN 2 THEN 'failed' ELSE 'unknown' END AS settled FROM events""")
def delivery_status(spark, d):
    shapes = F.array(F.lit("{}"), F.lit('{"errcode":0}'), F.concat(F.lit('{"errcode":'), (F.col("event_id") + 1).cast("string"), F.lit("}")),
                     F.lit('{"errcode":"0"}'), F.lit('{"errcode":true}'), F.col("event_type"), F.lit(""))
    receipt = F.element_at(shapes, (F.col("event_id") % 7 + 1).cast("int"))
    status = delivery.receipt_status(receipt)
    return table(spark, d, "events").select("event_id", status.alias("status"), delivery.settle(status).alias("settled"))
