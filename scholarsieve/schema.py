"""Spark types of the engine's records.

Times are TIMESTAMP_NTZ holding the UTC wall clock, so no result depends on the
session time zone.
"""
from __future__ import annotations

PAPER = (
    "version_id string, title string, abstract string, categories array<string>, "
    "published string, updated string, authors array<string>, pdf_url string"
)
LOCATED_QUOTE = "struct<field:string, locator:string, quote:string, source_url:string, label:string>"
DECISION = (
    "struct<status:string, route:string, tier:string, reason:string, abstract_evidence:array<string>, "
    "uncertainty:array<string>, rl_is_method:boolean, dpo_is_method:boolean, theory_evidence:boolean, "
    f"transfer_evidence:boolean, score:double, review_evidence:array<{LOCATED_QUOTE}>>"
)
SECTION = "struct<locator:string, text:string, kind:string>"
FIGURE = "struct<label:string, locator:string, caption:string, image_path:string, required:boolean>"
QUALITY = (
    "struct<passed:boolean, fixture_kind:string, reading_order_ok:boolean, "
    "read_locators:array<string>, reasons:array<string>, physical_page_count:int, "
    "method_on_first_page:boolean, evaluation_on_first_page:boolean>"
)
BODY = (
    "struct<version_id:string, source_url:string, source_type:string, "
    f"sections:array<{SECTION}>, figures:array<{FIGURE}>, quality:{QUALITY}>"
)
SUMMARY = (
    "struct<background:string, contribution:string, method:string, experiments:string, "
    f"conclusion:string, evidence:array<{LOCATED_QUOTE}>>"
)
TRANSLATION = "struct<title_zh:string, abstract_zh:string>"
FIXTURE = (
    f"papers array<struct<{PAPER.replace(' array', ':array').replace(' string', ':string')}>>, "
    f"decisions map<string,{DECISION}>, reviews map<string,{DECISION}>, bodies map<string,{BODY}>, "
    f"summaries map<string,{SUMMARY}>, translations map<string,{TRANSLATION}>"
)
RULE_TRACE = (
    "struct<version_id:string, rules_fingerprint:string, source:string, "
    "clauses:array<struct<route:string, groups:array<string>, "
    "keywords:map<string,array<struct<keyword:string, fields:array<string>>>>>>>"
)
PAPER_STATE = (
    "base_id string, paper struct<version_id:string, title:string, abstract:string, categories:array<string>, "
    "published:timestamp_ntz, updated:timestamp_ntz, authors:array<string>, pdf_url:string>, "
    "first_discovered timestamp_ntz, versions array<string>, latest_version string, rule_hits array<string>, "
    f"rule_trace {RULE_TRACE}, stage string, decision {DECISION}, modules array<string>, intended_tier string, "
    f"tier_reason string, summary {SUMMARY}, title_zh string, abstract_zh string, pending_digest string, "
    "delivery_chain string, promotion_pending boolean, resend_pending boolean, manual_required boolean, "
    "manual_retry_until timestamp_ntz, manual_delivery_limit int, "
    f"presentation_rule_hits array<string>, presentation_rule_trace {RULE_TRACE}"
)
ATTEMPT_LOG = "base_id string, stage string, run_id string, at timestamp_ntz, failed boolean, error string"
EVENT_LOG = ("base_id string, digest_id string, kind string, tier string, mode string, status string, "
             "at timestamp_ntz, recovery_of string")
DIGEST_LOG = "digest_id string, run_id string, chain_root string, day date, kind string, status string, at timestamp_ntz"
USAGE_LOG = "run_id string, stage string, base_id string, at timestamp_ntz, cost double"
TRANSLATION_ERROR_LOG = "run_id string, stage string, base_id string, at timestamp_ntz, error string, response string"
SLOT_LOG = "day date, kind string, base_id string"

SUMMARY_FIELDS = ("background", "contribution", "method", "experiments", "conclusion")
ROUTES = (
    "medical_reasoning", "medical_objective", "general_rl",
    "transferable_objective", "general_reasoning", "irrelevant",
)
