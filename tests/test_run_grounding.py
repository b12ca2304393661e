"""Decisions of a run are grounded in the abstract, reviews in the body; the index and the page around the items."""
import json

from pyspark.sql import functions as F

from scholarsieve.operators import grounding, render
from scholarsieve.plans.daily import MockDelivery
from test_daily import decision, fixture, start

METHOD = "We train with Dice 0.85 on vessels."


def changed(path, change):
    with open(path) as source:
        data = json.load(source)
    change(data)
    with open(path, "w") as target:
        json.dump(data, target)
    return path


def evidence(field, quote="We train with Dice 0.85", url="https://arxiv.org/html/2610.00004v1", locator="section:Method"):
    return {"field": field, "locator": locator, "quote": quote, "source_url": url, "label": ""}


def test_a_quote_that_is_not_in_the_abstract_fails_the_selection(spark, tmp_path):
    source = changed(fixture(tmp_path), lambda d: d["decisions"]["2610.00001"].update(abstract_evidence=["words of another paper"]))
    run, papers = start(spark, tmp_path, source, MockDelivery())
    report = run.run(papers)
    assert "selection:decision_abstract_quote_unlocated:1" in report["errors"]
    rows = {r["base_id"]: r for r in run._papers().collect()}
    assert rows["2610.00001"]["decision"] is None and rows["2610.00002"]["decision"]["status"] == "select"
    # The index lists every collected paper under its head, the undecided one too, each with a title.
    index = run.store.load("paper_index").orderBy("part", F.desc("first_discovered"), F.desc("version_id")).collect()
    assert [r["part"] for r in index] == [0, 1, 2, 3, 4, 4, 4, 4] and index[0]["line"].startswith("# ")
    assert [r["version_id"] for r in index[4:]] == [f"2610.0000{i}v1" for i in (4, 3, 2, 1)]
    assert all(f"离线标题译文：Paper {i}" in r["line"] for i, r in zip((4, 3, 2, 1), index[4:]))


def test_reviews_need_located_body_evidence(spark, tmp_path):
    def review(d):
        quote = d["decisions"]["2610.00004"]["abstract_evidence"][0]
        d["reviews"]["2610.00004"] = {**decision("select", "transferable_objective", "full", 80, quote), "review_evidence": [evidence("theory"), evidence("transfer")]}

    run, papers = start(spark, tmp_path, changed(fixture(tmp_path), review), MockDelivery(), llm_summary=True, evidence=True)
    report = run.run(papers)
    assert not [e for e in report["errors"] if e.startswith("review:")]
    row = next(r for r in run._papers().collect() if r["base_id"] == "2610.00004")
    assert row["decision"]["status"] == "select" and row["decision"]["score"] == 80


def test_review_errors(spark):
    quote = "struct<field:string,locator:string,quote:string,source_url:string,label:string>"
    item = lambda field, **k: tuple(evidence(field, url="u", **k).values())
    rows = [("good", "select", "transferable_objective", [item("theory"), item("transfer")]),
            ("bare", "select", "transferable_objective", [item("theory")]),
            ("rl", "select", "general_rl", [item("theory")]),
            ("lost", "select", "general_rl", [item("method"), item("theory", quote="words found nowhere at all")]),
            ("place", "reject", "irrelevant", [item("theory", locator="section:Other")]),
            ("source", "select", "general_rl", [(*item("method")[:3], "elsewhere", "")]),
            ("none", "reject", "irrelevant", []), ("null", "reject", "irrelevant", None), ("nofield", "reject", "irrelevant", [item(None)])]
    reviews = spark.createDataFrame([(b, b, s, r, e) for b, s, r, e in rows], f"base_id string, version_id string, status string, route string, review_evidence array<{quote}>")
    sources = reviews.select("version_id", F.lit("section:Method").alias("locator"), F.lit(METHOD).alias("text"))
    urls = reviews.select("version_id", F.lit("u").alias("source_url"))
    found = {r["base_id"]: r["error"] for r in grounding.review_errors(reviews, sources, urls).collect()}
    assert found == {"good": None, "bare": "review_theory_transfer_evidence_missing", "rl": "review_method_evidence_missing", "lost": "evidence_quote_unlocated",
                     "place": "evidence_quote_unlocated", "source": "evidence_source_mismatch", "none": "review_evidence_missing", "null": "review_evidence_missing", "nofield": None}


def test_a_page_has_a_title_and_the_notes_of_its_run(spark):
    rendered = spark.createDataFrame([("d", "a", "full", "", 1, "block a"), ("d", "b", "light", "old", 2, "block b")],
                                     "digest_id string, base_id string, tier string, recovery_of string, position long, block string")
    order = ["recovery", "tier_order", "part", "position"]
    lines = [r["line"] for r in render.archive_page(rendered, F.lit("2026-10-05"), ["late", "thin"]).orderBy(*order).collect()]
    assert lines[0].startswith("# ") and "2026-10-05" in lines[0] and lines.index("block a") < lines.index("block b") and lines[-2:] == ["- late", "- thin"]
    plain = render.archive_page(rendered, F.lit("2026-10-05")).count()
    assert plain == len(lines) - 3 and render.archive_page(rendered.limit(0), F.lit("x")).count() == 0
