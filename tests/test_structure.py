"""Nested article markup: lineage, tables, figures, dropped elements, references."""
import time

import pytest
from pyspark.sql import functions as F

from scholarsieve.functions import arrays, markup
from scholarsieve.operators import fulltext

LONG = "long enough words to be kept as evidence of a section"


def read(spark, *pages):
    return fulltext.read_html(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"), "page_id").orderBy("page_id").collect()


def named(row, kind="section"):
    return {s.locator: s.text for s in row.sections if s.kind == kind}


def test_lineage_lists_and_parent_text(spark):
    [row] = read(spark, f"""<html><body><nav>menu</nav><article><section><h1>Bridges</h1><p>Parent {LONG}</p>
      <section><h2>Steel</h2><ul><li>item one {LONG}</li></ul><section><h3>Rust</h3><pre>code {LONG}</pre></section></section>
      tail of the parent <section><h2>Steel</h2>again {LONG}</section></section></article></body></html>""")
    assert list(named(row)) == ["section:Bridges", "section:Bridges / Steel", "section:Bridges / Steel / Rust", "section:Bridges / Steel#2"]
    assert named(row)["section:Bridges"] == f"Bridges Parent {LONG} tail of the parent"
    assert named(row)["section:Bridges / Steel"] == f"Steel item one {LONG}"


def test_ids_and_places_name_sections_without_heading(spark):
    [row] = read(spark, f"<main><section id='S1'>{LONG}</section><section>{LONG} b</section><section><section><h4>In</h4>{LONG}</section></section></main>")
    assert list(named(row)) == ["section:S1", "section:Unnamed 2", "section:In"]


def test_end_matter_goes_with_all_it_holds(spark):
    [row] = read(spark, f"""<article><section><h2>Data</h2>{LONG}</section><section><h2>REFERENCES</h2>{LONG}<section><h3>Books</h3>{LONG}
      <table><tr><td>a table of books</td></tr></table></section></section><div class="x ltx_acknowledgements">thanks {LONG}</div>
      <section class='ltx_bibliography'><h2>Cited</h2>{LONG}</section><footer>{LONG}</footer></article>""")
    assert [s.locator for s in row.sections] == ["section:Data"]


def test_equations_follow_the_prose_they_interrupt(spark):
    [row] = read(spark, f"""<article><section><h2>Law</h2>{LONG} before <table class="ltx_eqn_table ltx_equation"><tr><td>E = m</td><td>c2</td></tr></table> after
      <TABLE CLASS='ltx_equationgroup'><tr><td>F = a</td></tr></TABLE><table class="ltx_eqn"></table></section></article>""")
    assert named(row) == {"section:Law": f"Law {LONG} before after Equations: E = m c2 ; F = a"} and not row.figures


def test_tables_are_known_by_caption_id_or_place(spark):
    [row] = read(spark, """<article><section><h2>Results</h2><table><caption>Table 4. Loads</caption><tr><td>first load</td></tr></table>
      <table id="T.b"><tr><td>the second load</td></tr></table><figure class="ltx_table big" id="T-c"><figcaption>No number</figcaption>
      <table><tr><td>third load</td></tr></table></figure><figure id="9c"><table id="9 d"><tr><td>the fourth load</td></tr></table></figure>
      <table><tr><td>tiny</td></tr></table></section></article>""")
    assert named(row, "table") == {"table:Table 4": "Table 4. Loads Table 4. Loads first load", "table:html-id:T.b": "the second load",
                                   "table:html-id:T-c": "No number third load", "table:html-node:4": "the fourth load"}
    assert [(f.label, f.locator, f.caption, f.required) for f in row.figures] == [
        ("Table 4", "caption:Table 4", "Table 4. Loads", False), ("HTML table id T-c", "caption:html-id:T-c", "No number", False)]


def test_figures_in_flat_and_nested_pages(spark):
    flat, nested = read(spark, f"""<body><h2>Plan</h2><p>{LONG}</p><figure><p>not prose</p><figcaption>Fig. 2: The framework</figcaption></figure></body>""",
                        """<body><section><figure><div class="ltx_caption">Figure S1 - A view</div></figure><figure>no caption</figure>
      <figure><figcaption>Words only, a pipeline</figcaption></figure></section></body>""")
    assert named(flat) == {"section:Plan": LONG} and [(f.label, f.required) for f in flat.figures] == [("Fig. 2", True)]
    assert [(f.label, f.locator, f.required) for f in nested.figures] == [("Figure S1", "caption:Figure S1", False), ("figure 2", "caption:figure 2", True)]


def test_stray_and_missing_end_tags(spark):
    [row] = read(spark, f"<article></section></div><section><h2>One</h2>{LONG}</table><div><section><h3>Two</h3>{LONG} x</section><aside>gone<p>gone</section><section><h2>Three</h2>{LONG}</section></article>")
    assert list(named(row)) == ["section:One", "section:One / Two", "section:Three"] and "gone" not in named(row)["section:One"]


def test_missing_empty_and_null_pages(spark):
    rows = read(spark, None, "", "<p>no body", "<body></body>", f"<article>{'<section>' * 3}</article>")
    assert [r.error for r in rows] == ["html_body_missing"] * 4 + [None] and all(r.sections == [] and r.figures == [] for r in rows)


def test_references(spark):
    texts = ["a &lt;b&gt; &amp;lt; &#65;&#x42;&#x1F600;", "&#0; &#xD800; &#9999999; &unknown; &", "&alpha;&nbsp;&hellip;", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(markup.references(F.col("t")).alias("x")).collect()]
    assert got == ["a <b> &lt; AB\U0001F600", "&#0; &#xD800; &#9999999; &unknown; &", "α\xa0…", None]


def test_scans_and_runs_are_those_of_a_loop(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 127, 128, 129, 1000)], "xs array<int>")
    step = lambda state, x: F.struct((state + x).alias("state"), (state + x).alias("out"))
    for r in rows.select("xs", arrays.scan(F.col("xs"), F.lit(0), step, "int").alias("sums"), arrays.runs(F.col("xs"), lambda x: F.floor(x / 3)).alias("runs")).collect():
        assert r.sums == [sum(r.xs[:i + 1]) for i in range(len(r.xs))] and sum(r.runs, []) == r.xs and all(len(x) <= 3 for x in r.runs)
    names = spark.createDataFrame([(["b", "a", "b", None, "b", None],)], "n array<string>")
    assert names.select(arrays.occurrence_numbers(F.col("n")).alias("x")).first().x == [1, 1, 2, 1, 3, 2]


@pytest.mark.parametrize("unit, times", [("<section><h2>x</h2>" + LONG, 100), ("<section><h2>x</h2>" + LONG + "</section>", 1500), ("<div>a", 1500),
                                         ("<table><tr><td>a cell of a table</table>", 1500)])
def test_long_and_deep_pages_do_not_stall(spark, unit, times):
    page = spark.createDataFrame([("<article>" + unit * times,)], "html string").withColumn("page_id", F.lit(1))
    begin = time.time()
    fulltext.read_html(page, "page_id").collect()
    assert time.time() - begin < 60
