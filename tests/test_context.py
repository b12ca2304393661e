"""What is sent to a model is measured whole; page statistics reach a verdict."""
import json

from pyspark.sql import functions as F

from scholarsieve.operators import fulltext

BODY = "id int, source_url string, sections array<struct<locator:string,text:string,kind:string>>, figures array<struct<label:string,locator:string,caption:string>>, figure_pages map<string,int>"


def python_length(url, sections, figures, pages):
    """The same context as the json module writes it."""
    return len(json.dumps({
        "source_url": url, "sections": [{"locator": loc, "text": text} for loc, text, _ in sections],
        "captions": [{"locator": loc, "label": label, "caption": caption, "pdf_physical_page": pages.get(label)} for label, loc, caption in figures],
        "coverage": [loc for loc, text, _ in sections if text.strip()]}, ensure_ascii=False))


def context(bodies, limit, **options):
    return {r.id: r.x for r in bodies.select("id", fulltext.reading_context(bodies, limit, **options).alias("x")).collect()}


def test_context_is_measured_to_the_character(spark):
    rows = [(1, "https://a/b", [("s:1", 'quote " back \\ line\n tab\t', "section"), ("s:2", " ", "section"), ("t:1", "ünï 東京", "table")], [("Figure 1", "caption:Figure 1", "It's"), ("x", "caption:x", "y")], {"Figure 1": 3}),
            (2, "u", [("only", "t" * 900, "section")], [], {}), (3, "u", [], [], {})]
    bodies = spark.createDataFrame(rows, BODY)
    for id_, *parts in rows:
        n = python_length(*parts)
        for limit, verdict in ((n, "direct"), (n - 1, "fulltext_exceeds_direct_input_limit")):
            assert context(bodies.where(F.col("id") == id_), limit, evidence_on=False)[id_] == verdict


def test_captions_alone_can_pass_the_limit_and_calls_are_bounded(spark):
    text = "A sentence of some words. " * 300
    bodies = spark.createDataFrame([(1, "u", [("s", "short", "section")], [("F", "caption:F", "c" * 2000)], {}), (2, "u", [("s", text, "section")], None, None)], BODY)
    assert context(bodies, 1500, evidence_on=True) == {1: "chunk_notes", 2: "chunk_notes"}
    assert context(bodies, 1500, evidence_on=True, chunk_chars=700, max_section_calls=3) == {1: "chunk_notes", 2: "section_call_limit_exceeded"}
    made = fulltext.chunks(bodies.where("id = 2"), fulltext.chunk_cap(700, 1500), "id").agg(F.max("chunk")).first()[0] + 1
    assert context(bodies, 1500, evidence_on=True, chunk_chars=700, max_section_calls=made)[2] == "chunk_notes"
    assert context(bodies, 1500, evidence_on=True, chunk_chars=700, max_section_calls=made - 1)[2] == "section_call_limit_exceeded"


def test_page_verdicts(spark):
    prose = "words of a page that has enough of them to count as read, line after line. "
    pages = [("ok", 1, "Methods\n" + prose * 2), ("ok", 2, "Results\n" + prose * 2), ("one", 1, "Methods\n" + prose + "\nResults\n" + prose), ("bare", 1, prose * 2), ("bare", 2, prose * 2),
             ("gap", 1, "Methods\n" + prose * 2 + "\nResults"), ("gap", 2, "short"), ("broken", 1, "Methods\nResults\n" + "a\n" * 90 + "�" * 9), ("empty", 1, None), ("empty", 2, "")]
    stats = fulltext.page_stats(spark.createDataFrame(pages, "version_id string, page int, raw string"))
    got = {r.version_id: (r.passed, r.reasons) for r in fulltext.pdf_quality(stats, 100).collect()}
    assert got["ok"] == (True, []) and got["one"] == (True, [])
    assert got["bare"][1] == ["method_section_missing", "evaluation_or_theory_section_missing"]
    assert got["gap"][1] == ["missing_or_unreadable_pages"]
    assert got["broken"][1] == ["reading_order_uncertain", "replacement_glyphs"]
    assert got["empty"][1] == ["too_short", "no_section_structure", "method_section_missing", "evaluation_or_theory_section_missing", "reading_order_uncertain", "missing_or_unreadable_pages"]
