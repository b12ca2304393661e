"""End-to-end daily runs over a small scripted fixture."""
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from scholarsieve import config as settings
from scholarsieve.plans.daily import DailyRun, FixtureAnalysis, MockDelivery
from scholarsieve.sources.fixtures import Fixture
from scholarsieve.sources.sinks import Conflict, Store

NOW = datetime(2026, 10, 5, 3, 0, tzinfo=timezone.utc)


def decision(status, route, tier, score, quote):
    return {"status": status, "route": route, "tier": tier, "reason": "scripted", "abstract_evidence": [quote], "uncertainty": ["unclear"] if status == "uncertain" else [],
            "rl_is_method": False, "dpo_is_method": False, "theory_evidence": True, "transfer_evidence": True, "score": score, "review_evidence": []}


def fixture(tmp_path, extra=0):
    texts = {1: "Medical reasoning segmentation of vessels with a vision-language model.", 2: "Reasoning segmentation of scenes by chain of thought.",
             3: "Medical image segmentation with a loss for boundary shapes.", 4: "Segmentation objective with provable transferable topology."}
    for i in range(5, 5 + extra):
        texts[i] = texts[1]
    key = lambda i: f"2610.{i:05d}"
    papers = [{"version_id": key(i) + "v1", "title": f"Paper {i}", "abstract": t, "categories": ["cs.CV"], "published": f"2026-10-04T00:{i:02d}:00+00:00",
               "updated": f"2026-10-04T00:{i:02d}:00Z", "authors": [f"A{i}"], "pdf_url": ""} for i, t in texts.items()]
    decisions = {key(1): decision("select", "medical_reasoning", "full", 97, texts[1][:30]), key(2): decision("select", "general_reasoning", "full", 71, texts[2][:30]),
                 key(3): decision("reject", "irrelevant", "light", 33, texts[3][:30]), key(4): decision("uncertain", "transferable_objective", "full", 64, texts[4][:30])}
    bodies = {k: {"version_id": k + "v1", "source_url": f"https://arxiv.org/html/{k}v1", "source_type": "html", "sections": [{"locator": "section:Method", "text": "We train with Dice 0.85 on vessels.", "kind": "section"}],
                  "figures": [], "quality": {"passed": True, "reasons": []}} for k in (key(1), key(4))}
    field = lambda f: {"field": f, "locator": "section:Method", "quote": "We train with Dice 0.85", "source_url": f"https://arxiv.org/html/{key(1)}v1", "label": ""}
    names = ("background", "contribution", "method", "experiments", "conclusion")
    summaries = {key(1): {**{n: f"{n} text" for n in names}, "evidence": [field(n) for n in names]}}
    for i in range(5, 5 + extra):
        decisions[key(i)] = decision("select", "medical_reasoning", "full", 50 - i, texts[1][:30])
        bodies[key(i)] = {**bodies[key(1)], "version_id": key(i) + "v1", "source_url": f"https://arxiv.org/html/{key(i)}v1"}
        summaries[key(i)] = {**summaries[key(1)], "evidence": [{**e, "source_url": f"https://arxiv.org/html/{key(i)}v1"} for e in summaries[key(1)]["evidence"]]}
    path = tmp_path / "fixture.json"
    path.write_text(json.dumps({"papers": papers, "decisions": decisions, "bodies": bodies, "summaries": summaries, "reviews": {}, "translations": {}}))
    return str(path)


def start(spark, tmp_path, source, delivery=None, now=NOW, **presentation):
    config = settings.builtin()
    config["presentation"].update(presentation)
    data = Fixture(spark, source)
    return DailyRun(Store(spark, str(tmp_path / "state")), settings.validate(config), FixtureAnalysis(data), delivery, now), data.papers()


def test_metadata_run_lists_accepted_papers_without_full_text_calls(spark, tmp_path):
    delivery = MockDelivery()
    run, papers = start(spark, tmp_path, fixture(tmp_path), delivery)
    report = run.run(papers)
    assert (report["records"], report["translation"], report["full"], report["light"]) == (4, 3, 0, 0)
    assert report["status"] == "confirmed" and report["calls"]["selection"] == 4
    assert "review" not in report["calls"] and "summary" not in report["calls"]
    title, body = delivery.sent[0]
    assert len(delivery.sent) == 1 and "离线标题译文：Paper 1" in body and len(body.encode()) <= 30000
    sizes = {r["message_bytes"] for r in run.store.load("notification").collect()}
    assert sizes == {len(body.encode())}
    again, papers = start(spark, tmp_path, fixture(tmp_path), delivery, NOW + timedelta(hours=1))
    later = again.run(papers)
    assert (later["delivery_kind"], later["records"]) == ("empty", 4) and len(delivery.sent) == 2 and "Paper" not in delivery.sent[1][1]


def test_full_run_reviews_summarizes_and_fills_tiers(spark, tmp_path):
    delivery = MockDelivery()
    run, papers = start(spark, tmp_path, fixture(tmp_path), delivery, llm_summary=True, evidence=True)
    report = run.run(papers)
    assert (report["full"], report["light"], report["records"]) == (1, 1, 4)
    assert {k: report["calls"][k] for k in ("selection", "review", "summary")} == {"selection": 4, "review": 1, "summary": 1}
    stages = {r["base_id"]: r["stage"] for r in run._papers().collect()}
    assert stages["2610.00004"] == "uncertain" and stages["2610.00003"] == "rejected" and stages["2610.00001"] == "delivered"


def test_captions_are_evidence_and_first_pages_count(spark, tmp_path):
    source = fixture(tmp_path)
    data = json.loads(open(source).read())
    key = "2610.00001"
    data["bodies"][key]["figures"] = [{"label": "Figure 1", "locator": "caption:Figure 1", "caption": "Figure 1: vessels before and after", "image_path": "", "required": False}]
    data["summaries"][key]["evidence"][1] |= {"locator": "caption:Figure 1", "quote": "vessels before and after"}
    (tmp_path / "captions.json").write_text(json.dumps(data))
    run, papers = start(spark, tmp_path, str(tmp_path / "captions.json"), MockDelivery(), llm_summary=True, evidence=True)
    assert run.run(papers)["full"] == 1


def test_a_failing_run_leaves_a_report_without_credentials(spark, tmp_path):
    class Broken(MockDelivery):
        def send(self, title, body):
            raise RuntimeError("no answer from https://push.example.com/send?sendkey=abc123secret")

    run, papers = start(spark, tmp_path, fixture(tmp_path), Broken())
    with pytest.raises(RuntimeError):
        run.run(papers)
    report = json.loads((tmp_path / "state/reports" / f"{run.run_id}.json").read_text())
    assert report["status"] == "run_failed" and report["calls"]["selection"] == 4
    assert "abc123secret" not in json.dumps(report) and "[REDACTED]" in json.dumps(report)


def test_what_a_record_shows_is_frozen_with_its_decision(spark, tmp_path):
    run, papers = start(spark, tmp_path, fixture(tmp_path))
    run.run(papers)
    first = {r["base_id"]: r["presentation_rule_hits"] for r in run._papers().collect()}
    assert any(first.values())
    run._save(run._papers().withColumn("rule_hits", F.array(F.lit("later_route"))))
    again, papers = start(spark, tmp_path, fixture(tmp_path), None, NOW + timedelta(hours=1))
    again.select()
    assert {r["base_id"]: r["presentation_rule_hits"] for r in again._papers().collect()} == first


def test_quota_overflow_turns_light(spark, tmp_path):
    run, papers = start(spark, tmp_path, fixture(tmp_path, extra=6), MockDelivery(), llm_summary=True)
    report = run.run(papers)
    assert report["full"] == 5 and report["light"] == 3


def test_unknown_delivery_is_recovered_until_the_chain_is_spent_and_can_be_retried(spark, tmp_path):
    source = fixture(tmp_path)

    def day(n, retry=False):
        delivery = MockDelivery("queued")
        run, papers = start(spark, tmp_path, source, delivery, NOW + timedelta(days=n))
        run.config["delivery"]["chain_attempts"] = 2
        if retry:
            run.retry("delivery", ["2610.00001"])
        return run.run(papers)["status"], delivery.sent

    assert day(0)[0] == "unknown"
    status, sent = day(1)
    assert status == "unknown" and "补发" in sent[0][1]
    assert day(2) == ("none", [])
    status, sent = day(3, retry=True)
    assert status == "unknown" and "Paper 1" in sent[0][1] and "Paper 2" not in sent[0][1]


def test_promotion_and_resend(spark, tmp_path):
    source = fixture(tmp_path)
    run, papers = start(spark, tmp_path, source, MockDelivery(), llm_summary=True)
    run.run(papers)
    with pytest.raises(ValueError, match="confirmed_light_only"):
        run.promote(["2610.00001"])
    with pytest.raises(ValueError, match="existing_record"):
        run.promote(["2610.09999"])
    delivery = MockDelivery()
    again, papers = start(spark, tmp_path, source, delivery, NOW + timedelta(days=1), llm_summary=True)
    again.resend(["2610.00001"])
    report = again.run(papers)
    assert (report["status"], report["full"], report["light"]) == ("confirmed", 1, 0) and not report["calls"].get("summary")
    assert "Paper 1" in delivery.sent[0][1]


def test_command_line_preview(spark, capsys):
    from scholarsieve.__main__ import main

    assert main(["config", "--abstract", "medical segmentation with a loss", "--category", "cs.CV"]) == 0
    shown = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert shown["routes"] == ["medical_objective", "transferable_objective"] and shown["rule_trace"]["clauses"]
    assert main(["config", "--abstract", "x", "--config", "/dev/null/none"]) == 2


def test_only_one_run_at_a_time(spark, tmp_path):
    run, papers = start(spark, tmp_path, fixture(tmp_path))
    run.store.lock()
    with pytest.raises(Conflict):
        run.run(papers)
