"""Full text, grounding, votes, state tables and sinks."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scholarsieve import schema
from scholarsieve.operators import feedback, fulltext, grounding, state
from scholarsieve.sources import documents, sinks
from scholarsieve.sources.sinks import Conflict, Store

BRIDGES = """<html><head><title>x</title></head><body><nav><p>menu entries that would be long enough to be a section of their own</p></nav><article>
  <h1>Cable bridges &amp; wind</h1><p>Long spans sway when steady gusts meet their lowest natural frequency.</p>
  <h2>Approach</h2><p>A damper is tuned <b>twice</b> a year by<br>two people with a wrench.<p>Its mass follows the deck.</p><script>var p = "<p>no</p>";</script>
  <h2>Results</h2><p>short</p>
  <h2>Results</h2><p>Sway fell by a third on nine of the ten bridges that were measured.</p>
  <figure><img src=a.png><figcaption>Figure 7: Architecture of the damper</figcaption></figure><figure><figcaption>Photo from the deck</figcaption></figure>
  <figure><figcaption>Table 2: Results per bridge</figcaption></figure>
  <h2>References</h2><p>A list of works that is long enough but belongs to the end matter.</p></article>
  <footer><p>address of the bridge office, also long enough to be taken for text</p></footer></body></html>"""


def read(spark, *pages):
    return fulltext.read_html(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"), "page_id")


def test_sections_and_figures_of_pages(spark):
    rows = read(spark, BRIDGES, "no markup at all", "<main><p>" + "w" * 39 + "</main>", None, "<body>" + "<h2>Same</h2><p>twenty words " * 3 + "that reach the least length").orderBy("page_id").collect()
    assert [(s.locator, s.text) for s in rows[0].sections] == [
        ("section:Cable bridges & wind", "Long spans sway when steady gusts meet their lowest natural frequency."),
        ("section:Approach", "A damper is tuned twice a year by two people with a wrench. Its mass follows the deck."),
        ("section:Results", "Sway fell by a third on nine of the ten bridges that were measured.")]
    assert [(f.label, f.locator, f.required) for f in rows[0].figures] == [
        ("Figure 7", "caption:Figure 7", True), ("figure 2", "caption:figure 2", False), ("Table 2", "caption:Table 2", False)]
    assert [r.error for r in rows[:4]] == [None, "html_body_missing", None, "html_body_missing"] and [r.sections for r in rows[1:4]] == [[], [], []]
    assert [s.locator for s in rows[4].sections] == ["section:Same"]


def test_later_uses_of_a_heading_are_numbered(spark):
    page = "<body>" + "".join(f"<h3>Notes</h3><p>entry number {i} of the notes, which is quite long</p>" for i in range(3))
    assert [s.locator for s in read(spark, page).first().sections] == ["section:Notes", "section:Notes#2", "section:Notes#3"]


def test_quality_gate(spark):
    gate = read(spark, BRIDGES, BRIDGES.replace("Approach", "History")).withColumn("q", fulltext.quality(100, F.lit("html"))).orderBy("page_id").collect()
    assert gate[0].q.passed and gate[0].q.section_count == 3
    assert gate[1].q.reasons == ["method_section_missing"]
    assert read(spark, "<body><p>x</p></body>").select(fulltext.quality(10, F.lit("pdf"), F.lit(False), F.lit(1)).alias("q")).first().q.reasons == [
        "too_short", "no_section_structure", "method_section_missing", "evaluation_or_theory_section_missing", "reading_order_uncertain", "missing_or_unreadable_pages"]


@pytest.mark.parametrize("seed", range(3))
def test_chunks_keep_all_text_within_the_cap(spark, seed):
    rng = random.Random(seed)
    sections = [(f"s{i}", "".join(rng.choice(["word ", "x", ". ", "。"]) for _ in range(rng.randrange(0, 900))), "section") for i in range(6)] + [("s9", None, "section")]
    cap = (256, 300, 700)[seed]
    bodies = spark.createDataFrame([(1, sections), (2, None), (3, [])], "id int, sections array<struct<locator:string,text:string,kind:string>>")
    pieces = fulltext.chunks(bodies, cap, "id").orderBy("id", "seq").collect()
    assert {p.id for p in pieces} == {1} and [p.seq for p in pieces] == list(range(len(pieces)))
    for locator, text, _ in sections:
        own = [p.text for p in pieces if p.locator == locator]
        assert "".join(own) == (text or "")
        # Cut after a mark beyond the middle, or at the cap where there is none.
        for piece, rest in zip(own, own[1:]):
            assert cap // 2 < len(piece) <= cap and (len(piece) == cap or piece[-1] in " .。")
    sizes = {}
    for p in pieces:
        sizes[p.chunk] = sizes.get(p.chunk, 0) + len(p.text)
    assert all(v <= cap for v in sizes.values()) and list(sizes) == list(range(len(sizes)))
    # The first piece of a chunk did not fit into the chunk before.
    for before, after in zip(pieces, pieces[1:]):
        if before.chunk != after.chunk:
            assert sizes[before.chunk] + len(after.text) > cap
    with pytest.raises(ValueError):
        fulltext.chunk_cap(1000, 700)


def test_pdf_page_lines(spark):
    raw = "Journal of Tests\n\nMethods\n" + "We train the predictor on many paired masks and report it.\n" * 3 + "page foot"
    pages = spark.createDataFrame([("v", 1, raw), ("v", 2, raw.replace("Methods", "Experiments")), ("v", 3, "tiny"), ("w", 1, raw)], "version_id string, page int, raw string")
    margins = fulltext.repeated_margins(pages)
    assert {r.line for r in margins.where("version_id = 'v'").collect()} == {"Journal of Tests", "page foot", "We train the predictor on many paired masks and report it."} and margins.where("version_id = 'w'").count() == 0
    cleaned = {(r.version_id, r.page): r.raw for r in fulltext.drop_margins(pages, margins).collect()}
    assert "Journal" not in cleaned["v", 1] and "Journal" in cleaned["w", 1]
    stats = {r.version_id: r for r in fulltext.page_stats(pages).collect()}
    assert (stats["v"].missing_pages, stats["v"].has_method, stats["v"].has_evaluation_or_theory, stats["v"].method_on_first_page, stats["v"].evaluation_on_first_page) == (1, True, True, True, False)


def test_quotes_are_located_in_their_own_passage(spark):
    sections = spark.createDataFrame([("v", "a", 0, "The Dice score ＲＩＳＥＳ to 0.85 here."), ("v", "a", 1, "later duplicate")], "version_id string, locator string, pos int, text string")
    figures = spark.createDataFrame([("v", "c", 0, "Figure 1: overall framework")], "version_id string, locator string, pos int, caption string")
    quotes = [("v", "a", "dice  score rises to"), ("v", "a", "later duplicate"), ("v", "c", "overall framework"), ("v", "z", "overall framework"), ("v", "a", "short")]
    rows = grounding.locate(spark.createDataFrame(quotes, "version_id string, locator string, quote string"), grounding.passages(sections, figures)).collect()
    assert {(r.locator, r.quote) for r in rows if r.error is None} == {("a", "dice  score rises to"), ("c", "overall framework")}


BALLOTS = """<!-- vote:2610.1:like -->
- [x] good <!-- vote:2610.1:like -->\r
- [ ] bad <!-- vote:2610.1:dislike -->\r
  - [X] good <!-- vote:2610.2:like -->
- [x] bad <!-- vote:2610.2:dislike -->
- [ ] good <!-- vote:2610.3:like --> trailing
- [ ] bad <!-- vote:2610.3:dislike -->
- [ ] good <!-- vote:2610.4:like -->
- [ ] bad <!-- vote:2610.4:dislike -->

- [x] inner <!-- vote:2610.9:like --> <!-- vote:2610.5:like -->
- [ ] bad <!-- vote:2610.5:dislike -->"""


def test_only_marked_check_boxes_are_ballots(spark):
    bodies = spark.createDataFrame([("d", BALLOTS)], "day string, body string")
    expected = spark.createDataFrame([("d", f"2610.{i}") for i in range(1, 7)], "day string, base_id string")
    votes = {r.base_id: r.vote for r in feedback.parse_votes(bodies, expected).collect()}
    assert votes == {"2610.1": "like", "2610.2": "conflict", "2610.3": "invalid", "2610.4": "pending", "2610.5": "like", "2610.6": "invalid"}


def trace(*clauses):
    return ("v", "f", "matched", [(route, groups, {g: [(w, ["abstract"]) for w in words] for g, words in keywords.items()}) for route, groups, keywords in clauses])


def test_votes_count_once_per_paper_and_later_pending_never_erases(spark):
    one = trace(("r", ["B", "A"], {"A": ["x"], "B": ["y", "z"]}), ("r", ["A", "B"], {"A": ["x"], "B": ["y", "z"]}))
    rows = [("2026-10-01", "p1", "like", one), ("2026-10-02", "p1", "pending", one), ("2026-10-01", "p2", "like", one), ("2026-10-03", "p2", "dislike", one), ("2026-10-01", "p3", "pending", one),
            ("2026-10-02", "p4", "conflict", one), ("2026-10-01", "p4", "like", one)]
    votes = feedback.effective(spark.createDataFrame(rows, f"day string, base_id string, vote string, rule_trace {schema.RULE_TRACE}"))
    assert {r.base_id: r.vote for r in votes.collect()} == {"p1": "like", "p2": "dislike", "p3": "pending", "p4": "conflict"}
    assert [(list(r.groups), r.like, r.dislike) for r in feedback.tally_combinations(votes).collect()] == [(["A", "B"], 1, 1)]
    assert {(r.group, r.keyword, r.like, r.dislike) for r in feedback.tally_keywords(votes).collect()} == {("A", "x", 1, 1), ("B", "y", 1, 1), ("B", "z", 1, 1)}
    assert feedback.rated_papers(votes).first().rated_papers == 2


def test_stage_attempts_defer_the_same_day_and_clear_on_success(spark):
    at = datetime(2026, 10, 1, 3)
    log = [("a", "s", at, True), ("b", "s", at, True), ("b", "s", at + timedelta(hours=1), False), ("c", "s", at - timedelta(days=1), True)] + [("d", "s", at - timedelta(days=i), True) for i in range(1, 4)]
    counts = state.stage_attempts(spark.createDataFrame(log, "base_id string, stage string, at timestamp_ntz, failed boolean"))
    gate = counts.withColumn("gate", state.stage_gate(F.lit("2026-10-01 20:00:00").cast("timestamp_ntz"), F.col("stage"), 3))
    assert {r.base_id: r.gate for r in gate.collect()} == {"a": "recovery_deferred_after_failure", "b": "run", "c": "run", "d": "attempts_exhausted_manual_required"}


def test_store_versions_logs_and_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.load("t") is None
    assert store.save("t", spark.range(3)).count() == 3
    assert store.save("t", store.load("t").where("id > 0")).count() == 2
    assert store.log("l", "id long").count() == 0
    store.append("l", spark.range(2))
    store.append("l", spark.range(2))
    assert store.log("l", "id long").count() == 4
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string")
    store.snapshot("archive/x", lines, ["n"])
    store.snapshot("archive/x", lines.repartition(3), ["n"])
    assert [r.value for r in spark.read.text(str(tmp_path / "s/archive/x")).collect()] == ["a", "b"]
    with pytest.raises(Conflict):
        store.snapshot("archive/x", lines.where("n = 1"), ["n"])
    store.report("r.json", {"a": 1})
    store.lock()
    with pytest.raises(Conflict):
        store.lock()
    store.unlock()
    store.lock()


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("b", "bv1", "2026-10-01 08:00", 'a "quoted", <title>', "https://x", ["cs.CV"], ["r"], {"G": ["w"]}, "text\nline", datetime(2026, 10, 1))],
                                 "base_id string, version_id string, published_local string, title string, link string, categories array<string>, routes array<string>, matched_groups map<string,array<string>>, abstract string, published timestamp_ntz")
    sinks.export_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (back.title, back.matched_groups, back.abstract) == ('a "quoted", <title>', '{"G":["w"]}', "text\nline")
    assert "&lt;title&gt;</a>" in sinks.html_rows(rows).first().row


def test_public_files_and_stored_documents(spark, tmp_path):
    for name, data in {"a.html": b"<body>x</body>", "big.html": b"x" * 50, "a.pdf": b"%PDF-1", "b.pdf": b"html", "note.txt": b"key sk-" + b"a" * 24}.items():
        (tmp_path / name).write_bytes(data)
    html = {r.version_id: (r.html, r.error) for r in documents.html_files(spark, str(tmp_path), 20).collect()}
    assert html == {"a": ("<body>x</body>", None), "big": (None, "source_too_large")}
    assert {r.version_id: r.error for r in documents.pdf_files(spark, str(tmp_path), 20).collect()} == {"a": None, "b": "pdf_response_invalid"}
    found = documents.public_findings(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.path.rsplit("/", 1)[1], r.finding) for r in found] == [("note.txt", "credential_shape")]


