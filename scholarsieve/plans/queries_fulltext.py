"""Full-text extraction, gate, chunk and page queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from scholarsieve.functions import markup
from scholarsieve.operators import fulltext, state
from scholarsieve.plans import stand_ins as s
from scholarsieve.plans.registry import query, table


def _sql_text(x: str) -> str:
    text = f"regexp_replace({x}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
    for name, mark in markup.ENTITIES:
        text = f"replace({text}, '{name}', '{mark.replace(chr(39), chr(39) * 2)}')"
    return s.sql_collapse(text)


def _sql_article() -> str:
    html = "html"
    for tag in markup.DROPPED:
        html = f"regexp_replace({html}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    return html


_HTML = f"""cleaned AS (SELECT page_id, {_sql_article()} AS html FROM pages),
    bodies AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)(?:</article\\s*>|$)', 1), ''), nullif(regexp_extract(html, '(?is)<main\\b[^>]*>(.*?)(?:</main\\s*>|$)', 1), ''),
               nullif(regexp_extract(html, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|$)', 1), '')) AS body FROM cleaned),
    parts AS (SELECT page_id, unnest(string_split(regexp_replace(body, '(?i)<(h[1-6])\\b', chr(1) || '<\\1', 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(body, '(?i)<(h[1-6])\\b', chr(1) || '<\\1', 'g'), chr(1)), 1) AS nth FROM bodies),
    named AS (SELECT page_id, nth, coalesce(nullif({_sql_text("regexp_extract(part, '(?is)^<h[1-6]\\b[^>]*>(.*?)</h[1-6]\\s*>', 1)")}, ''), 'Introduction') AS name,
              array_to_string(list_filter(list_transform(regexp_split_to_array(part, '(?i)<p\\b[^>]*>')[2:], lambda p: {_sql_text("regexp_extract(p, '(?is)^(.*?)(?:</p\\s*>|$)', 1)")}), lambda w: w <> ''), ' ') AS text FROM parts),
    sections AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY nth) - 1 AS pos, text, name,
                 'section:' || name || CASE WHEN row_number() OVER (PARTITION BY page_id, name ORDER BY nth) > 1 THEN '#' || row_number() OVER (PARTITION BY page_id, name ORDER BY nth) ELSE '' END AS locator
                 FROM named WHERE length(text) >= 40 AND NOT regexp_matches(name, '(?i)^(references|bibliography|acknowledg(?:e)?ments?)$'))"""


@query(f"""
    WITH {_HTML} SELECT page_id, pos, locator, 'section' AS kind, length(text) AS chars, sha256(text) AS digest FROM sections""")
def html_sections(spark, d):
    bodies = fulltext.read_html(table(spark, d, "pages"), "page_id")
    return fulltext.sections(bodies, "page_id").select("page_id", "pos", "locator", "kind", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


@query(f"""
    WITH {_HTML}, gate AS (
        SELECT page_id, count(name) AS n, coalesce(length(string_agg(text, ' ' ORDER BY pos)), 0) AS chars, coalesce(string_agg(locator, ' ' ORDER BY pos), '') AS heads,
               coalesce(bool_or(NOT regexp_matches(locator, '{fulltext.NOT_METHOD}') AND regexp_matches(text[1:300], '{fulltext.METHOD_PROSE}')), FALSE) AS prose
        FROM pages LEFT JOIN sections USING (page_id) GROUP BY page_id)
    SELECT page_id, n AS section_count, chars AS read_chars, reasons = '' AS passed, reasons FROM (
        SELECT *, concat_ws(',', CASE WHEN chars < 2500 THEN 'too_short' END, CASE WHEN n < 2 THEN 'no_section_structure' END,
               CASE WHEN NOT (prose OR regexp_matches(heads, '{fulltext.METHOD}')) THEN 'method_section_missing' END,
               CASE WHEN NOT regexp_matches(heads, '{fulltext.EVALUATION}') THEN 'evaluation_or_theory_section_missing' END) AS reasons FROM gate)""")
def html_quality_gate(spark, d):
    bodies = fulltext.read_html(table(spark, d, "pages"), "page_id")
    gate = bodies.withColumn("q", fulltext.quality(2500, F.lit("html")))
    return gate.select("page_id", "q.passed", F.array_join("q.reasons", ",").alias("reasons"), "q.section_count", "q.read_chars")


def _restructured(spark, d):
    """The pages with sections put in: their title holds a section for the start, one for each further paragraph, and
    end matter; some line breaks become displayed equations."""
    html = F.replace(F.replace("html", F.lit("<h1>"), F.lit("<section><h2>")), F.lit("</h1>"), F.lit("</h2><section id='s0'><h3>Opening</h3><ul><li>First entry</li></ul>"))
    html = F.replace(html, F.lit("</p><p>"), F.lit("</p></section><section class='ltx_subsection'><h3>Step</h3><p>"))
    html = F.replace(html, F.lit("<br>"), F.lit("<table class='ltx_equationgroup ltx_eqn_table'><tr><td>a = b</td></tr></table>"))
    end = "</section></section><section><h2>References</h2><p>Left out, as long as it may be, with all of its entries.</p><section><h3>More</h3></section></section></article>"
    return table(spark, d, "pages").withColumn("html", F.replace(html, F.lit("</article>"), F.lit(end)))


@query(rf"""
    WITH inner_markup AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS html FROM pages),
    titled AS (SELECT page_id, {_sql_text("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title, string_split(regexp_extract(html, '(?s)</h1>(.*)', 1), '</p><p>') AS steps FROM inner_markup),
    parts AS (SELECT page_id, title, unnest(steps) AS part, generate_subscripts(steps, 1) AS nth FROM titled),
    own AS (
        SELECT page_id, 0 AS nth, array_to_string(list_filter([title], lambda n: n <> ''), ' / ') AS name, title AS prose, 0 AS equations FROM titled UNION ALL
        SELECT page_id, nth, array_to_string(list_filter([title, CASE WHEN nth = 1 THEN 'Opening' ELSE 'Step' END], lambda n: n <> ''), ' / '),
               trim(CASE WHEN nth = 1 THEN 'Opening First entry ' ELSE 'Step ' END || {_sql_text("part")}), len(string_split(part, '<br>')) - 1 FROM parts),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id, name ORDER BY nth) AS use,
                 prose || CASE WHEN equations > 0 THEN ' Equations: ' || array_to_string(list_transform(range(equations), lambda i: 'a = b'), ' ; ') ELSE '' END AS text FROM own),
    kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY nth) - 1 AS pos FROM numbered WHERE length(text) >= 40)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, 'section:' || CASE WHEN name = '' THEN 'Unnamed ' || (pos + 1) ELSE name || CASE WHEN use > 1 THEN '#' || use ELSE '' END END AS locator,
           length(text) AS chars, sha256(text) AS digest FROM kept""")
def nested_sections(spark, d):
    bodies = fulltext.read_html(_restructured(spark, d), "page_id")
    return fulltext.sections(bodies, "page_id").select("page_id", "pos", "locator", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


def _tabled(spark, d):
    """The pages with a table or figure between any two paragraphs: captioned, known by id, or of no identity; alone,
    or in a figure that carries caption and id."""
    n, turn = F.col("page_id").cast("string"), F.col("page_id") % 5
    cells = F.concat(F.lit("<tr><td>Total score "), n, F.lit("</td><td>0.5</td></tr></table>"))
    between = (F.when(turn == 0, F.concat(F.lit("<table><caption>Table "), n, F.lit(": Scores &amp; costs</caption>"), cells))
               .when(turn == 1, F.concat(F.lit("<table id='T."), n, F.lit("'>"), cells))
               .when(turn == 2, F.concat(F.lit("<table>"), cells))
               .when(turn == 3, F.concat(F.lit("<figure class='ltx_table' id='F"), n, F.lit("'><figcaption>All scores</figcaption><table>"), cells, F.lit("</figure>")))
               .otherwise(F.concat(F.lit("<figure><img><figcaption>Figure "), n, F.lit(": Overview of the pipeline</figcaption></figure>"))))
    html = F.replace(F.replace("html", F.lit("<h1>"), F.lit("<section><h2>")), F.lit("</h1>"), F.lit("</h2>"))
    html = F.replace(html, F.lit("</p><p>"), F.concat(F.lit("</p>"), between, F.lit("<p>")))
    return table(spark, d, "pages").withColumn("html", F.replace(html, F.lit("</article>"), F.lit("</section></article>")))


_TABLED = """put AS (
        SELECT page_id, page_id % 5 AS turn, unnest(range(1, CAST(len(string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</p><p>')) AS BIGINT))) AS nth FROM pages)"""


@query(f"""
    WITH {_TABLED} SELECT page_id, CAST(nth AS INTEGER) AS nth, CASE turn WHEN 0 THEN 'table:Table ' || page_id WHEN 1 THEN 'table:html-id:T.' || page_id WHEN 2 THEN 'table:html-node:' || nth
           ELSE 'table:html-id:F' || page_id END AS locator,
           CASE turn WHEN 0 THEN 'Table ' || page_id || ': Scores & costs Table ' || page_id || ': Scores & costs ' WHEN 3 THEN 'All scores ' ELSE '' END || 'Total score ' || page_id || ' 0.5' AS text
    FROM put WHERE turn < 4""")
def html_tables(spark, d):
    tables = fulltext.read_html(_tabled(spark, d), "page_id").select("page_id", F.posexplode(F.filter("sections", lambda x: x["kind"] == "table")).alias("nth", "t"))
    return tables.select("page_id", (F.col("nth") + 1).alias("nth"), "t.locator", "t.text")


@query(f"""
    WITH {_TABLED} SELECT page_id, CAST(nth AS INTEGER) AS nth, CASE turn WHEN 0 THEN 'Table ' WHEN 3 THEN 'HTML table id F' ELSE 'Figure ' END || page_id AS label,
           'caption:' || CASE turn WHEN 0 THEN 'Table ' WHEN 3 THEN 'html-id:F' ELSE 'Figure ' END || page_id AS locator,
           CASE turn WHEN 0 THEN 'Table ' || page_id || ': Scores & costs' WHEN 3 THEN 'All scores' ELSE 'Figure ' || page_id || ': Overview of the pipeline' END AS caption, turn = 4 AS required
    FROM put WHERE turn IN (0, 3, 4)""")
def html_figures(spark, d):
    figures = fulltext.read_html(_tabled(spark, d), "page_id").select("page_id", F.posexplode("figures").alias("nth", "f"))
    return figures.select("page_id", (F.col("nth") + 1).alias("nth"), "f.label", "f.locator", "f.caption", "f.required")


_NAMES = ("Introduction", "Our Method", "Results and Discussion", "Notes")


def _bodies(spark, d):
    """Documents as bodies: every line is a section, named in rotation."""
    lines = F.split("text", "\n")
    name = lambda i: F.element_at(F.array(*map(F.lit, _NAMES)), (i % 4 + 1).cast("int"))
    sections = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("section:"), name(i)).alias("locator"), x.alias("text"), F.lit("section").alias("kind")))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://arxiv.org/html/"), s.paper_key("doc_id")).alias("source_url"), sections.alias("sections"))


_LINES = """lines AS (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {'name': ['Introduction', 'Our Method', 'Results and Discussion', 'Notes'][(i - 1) % 4 + 1], 'text': x}),
                               lambda x: trim(x.text) <> '') AS parts FROM documents)"""


@query(f"""
    WITH {_LINES}, joined AS (SELECT doc_id, len(parts) AS n, length(array_to_string(list_transform(parts, lambda x: x.text), ' ')) AS chars,
           list_contains(list_transform(parts, lambda x: x.name), 'Our Method') AS method, list_contains(list_transform(parts, lambda x: x.name), 'Results and Discussion') AS evaluation FROM lines)
    SELECT doc_id, n AS section_count, chars AS read_chars, concat_ws(',', CASE WHEN chars < 1200 THEN 'too_short' END, CASE WHEN n < 2 THEN 'no_section_structure' END,
           CASE WHEN NOT method THEN 'method_section_missing' END, CASE WHEN NOT evaluation THEN 'evaluation_or_theory_section_missing' END) AS reasons
    FROM joined""")
def snapshot_quality(spark, d):
    gate = _bodies(spark, d).withColumn("q", fulltext.quality(1200, F.lit("html")))
    return gate.select("doc_id", "q.section_count", "q.read_chars", F.array_join("q.reasons", ",").alias("reasons"))


@query(f"""
    WITH {_LINES}, ok AS (SELECT doc_id, length(array_to_string(list_transform(parts, lambda x: x.text), ' ')) AS chars,
           len(parts) >= 2 AND len(list_intersect(list_transform(parts, lambda x: x.name), ['Our Method', 'Results and Discussion'])) = 2 AS fine FROM lines)
    SELECT doc_id, CASE WHEN fine AND chars >= 3000 THEN 'html' WHEN fine AND chars >= 1200 THEN 'pdf' END AS source_type,
           CASE WHEN NOT fine OR chars < 1200 THEN 'fulltext_quality_failed' END AS error FROM ok""")
def body_source_choice(spark, d):
    """Every body in two qualities: a strict one as HTML and a lenient one as PDF."""
    bodies = _bodies(spark, d)
    side = lambda least, kind: bodies.select(F.col("doc_id").alias("version_id"), F.struct("source_url").alias("body"), fulltext.quality(least, F.lit(kind)).alias("quality"))
    chosen = fulltext.choose_body(side(3000, "html"), side(1200, "pdf"))
    return chosen.select(F.col("version_id").alias("doc_id"), "source_type", F.substring_index("error", ":", 1).alias("error"))


@query("""
    SELECT p.doc_id, CASE WHEN l.doc_id IS NULL THEN 'fulltext_missing' WHEN l.quality = 0 OR p.doc_id % 3 = 0 THEN 'fulltext_gate_or_version_failed' END AS error
    FROM documents p LEFT JOIN labels l USING (doc_id)""")
def body_acceptance(spark, d):
    records = table(spark, d, "documents").select("doc_id", s.paper_key("doc_id").alias("base_id"), F.lit("v1").alias("version_id"))
    bodies = table(spark, d, "labels").select(s.paper_key("doc_id").alias("base_id"), F.when(F.col("doc_id") % 3 == 0, "v2").otherwise("v1").alias("version_id"), (F.col("quality") == 1).alias("qualified"))
    return fulltext.accept_body(records, bodies).select("doc_id", "error")


@query(f"""
    WITH {_LINES}, sent AS (
        SELECT doc_id, length(text) AS chars, list_transform(string_split(text, chr(10)), lambda x, i: {{'locator': 'section:' || ['Introduction', 'Our Method', 'Results and Discussion', 'Notes'][(i - 1) % 4 + 1], 'text': x}}) AS sections,
               list_transform(parts, lambda x: 'section:' || x.name) AS coverage,
               CASE WHEN doc_id % 2 = 0 THEN [{{'locator': 'caption:Figure 1', 'label': 'Figure 1', 'caption': "left"(text, 200), 'pdf_physical_page': CASE WHEN doc_id % 3 = 0 THEN 7 END}}] ELSE [] END AS captions
        FROM documents JOIN lines USING (doc_id)),
    measured AS (
        SELECT doc_id, length(CAST(to_json({{'source_url': 'https://arxiv.org/html/' || 'corpusa/0000000', 'sections': sections, 'captions': captions, 'coverage': coverage}}) AS VARCHAR))
               + 7 + 3 * len(sections) + len(sections) - 1 + 7 * len(captions) + greatest(len(coverage) - 1, 0) AS n FROM sent)
    SELECT doc_id, CASE WHEN n <= 2000 THEN 'direct' ELSE 'notes' END AS context FROM measured""")
def reading_context(spark, d):
    """All that is sent is measured: sections, captions of every second body, locators read."""
    n = F.col("doc_id")
    figure = F.struct(F.lit("Figure 1").alias("label"), F.lit("caption:Figure 1").alias("locator"), F.substring("text", 1, 200).alias("caption"))
    bodies = _bodies(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumns({
        "figures": F.when(n % 2 == 0, F.array(figure)), "figure_pages": F.create_map(F.lit("Figure 1"), F.when(n % 3 == 0, 7))})
    context = fulltext.reading_context(bodies, 2000, evidence_on=True, chunk_chars=1000, max_section_calls=4)
    return bodies.select("doc_id", context.alias("context")).select("doc_id", F.when(F.col("context") == "direct", "direct").otherwise("notes").alias("context"))


_CHUNK = 1000


@query(f"""
    WITH RECURSIVE texts AS (
        SELECT doc_id, nth, ['Introduction', 'Our Method', 'Results and Discussion', 'Notes'][(nth - 1) % 4 + 1] AS name, line FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents)),
    pieces AS (
        SELECT doc_id, nth, name, line, 0 AS start, CAST(NULL AS VARCHAR) AS piece FROM texts UNION ALL
        SELECT doc_id, nth, name, line, start + size, substr(line, start + 1, size) FROM (
            SELECT *, CAST(CASE WHEN start + {_CHUNK} < length(line) AND mark > {_CHUNK // 2} THEN mark + 1 ELSE length(w) END AS INTEGER) AS size FROM (
                SELECT *, greatest(CASE WHEN strpos(reverse(w), ' .') > 0 THEN length(w) - strpos(reverse(w), ' .') - 1 ELSE -1 END, CASE WHEN strpos(reverse(w), ' ') > 0 THEN length(w) - strpos(reverse(w), ' ') ELSE -1 END,
                                   CASE WHEN strpos(reverse(w), '。') > 0 THEN length(w) - strpos(reverse(w), '。') ELSE -1 END) AS mark
                FROM (SELECT *, substr(line, start + 1, {_CHUNK}) AS w FROM pieces WHERE start < length(line))))),
    ordered AS (SELECT doc_id, name, piece, length(piece) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY nth, start) AS seq FROM pieces WHERE piece IS NOT NULL),
    packed AS (
        SELECT doc_id, seq, 0 AS chunk, n AS size FROM ordered WHERE seq = 1 UNION ALL
        SELECT o.doc_id, o.seq, p.chunk + CASE WHEN p.size + o.n > {_CHUNK} THEN 1 ELSE 0 END, CASE WHEN p.size + o.n > {_CHUNK} THEN o.n ELSE p.size + o.n END
        FROM packed p JOIN ordered o ON o.doc_id = p.doc_id AND o.seq = p.seq + 1)
    SELECT doc_id, CAST(seq - 1 AS INTEGER) AS seq, chunk, 'section:' || name AS locator, n AS chars, sha256(piece) AS digest FROM packed JOIN ordered USING (doc_id, seq)""")
def section_chunks(spark, d):
    pieces = fulltext.chunks(_bodies(spark, d), fulltext.chunk_cap(_CHUNK, 120000), "doc_id")
    return pieces.select("doc_id", "seq", "chunk", "locator", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


@query("""
    SELECT doc_id, count(*) AS missing FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) % 2 = 1 GROUP BY doc_id""")
def chunk_cache_misses(spark, d):
    rows = _bodies(spark, d).select("doc_id", F.posexplode("sections").alias("pos", "c")).select("doc_id", "pos", F.col("c.text").alias("text"))
    keyed = rows.withColumn("chunk_key", F.sha2(F.to_json(F.struct("doc_id", "pos", "text")), 256))
    cache = keyed.where(F.length("text") % 2 == 0)
    return fulltext.uncached(keyed, cache).groupBy("doc_id").agg(F.count("*").alias("missing"))


def _pages(spark, d):
    """Documents as the pages of one source, with a running header on most of them."""
    header = F.when(F.col("doc_id") % 10 < 7, F.concat(F.lit("Proceedings of "), F.col("source"))).otherwise(F.concat(F.lit("page "), F.col("doc_id").cast("string")))
    raw = F.concat(header, F.lit("\n\n"), F.col("text"), F.lit("\nResults"))
    return table(spark, d, "documents").select(F.col("source").alias("version_id"), F.col("doc_id").alias("page"), raw.alias("raw"))


_PAGES = """pages_of AS (
    SELECT source, doc_id, CASE WHEN doc_id % 10 < 7 THEN 'Proceedings of ' || source ELSE 'page ' || doc_id END || chr(10) || chr(10) || text || chr(10) || 'Results' AS raw FROM documents)"""


@query(f"""
    WITH {_PAGES},
    filled AS (SELECT source, doc_id, list_filter(list_transform(regexp_split_to_array(raw, '\\r\\n|[\\n\\r]'), lambda x: {s.sql_collapse('x')}), lambda x: x <> '') AS lines FROM pages_of),
    edges AS (SELECT source, unnest(list_distinct(list_concat(lines[1:2], lines[-2:]))) AS line FROM filled),
    totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source)
    SELECT source, line, count(*) AS on_pages, any_value(pages) AS pages FROM edges JOIN totals USING (source)
    WHERE length(line) BETWEEN 4 AND 100 AND line <> 'Results' GROUP BY source, line HAVING count(*) >= 2 AND count(*) * 2 >= any_value(pages)""")
def repeated_margin_lines(spark, d):
    return fulltext.repeated_margins(_pages(spark, d)).select(F.col("version_id").alias("source"), "line", "on_pages", "pages")


@query(f"""
    WITH {_PAGES}
    SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN substr(raw, length('Proceedings of ' || source) + 2) ELSE raw END AS raw_text FROM pages_of""")
def margins_removed(spark, d):
    pages = _pages(spark, d)
    cleaned = fulltext.drop_margins(pages, fulltext.repeated_margins(pages))
    return cleaned.select(F.col("page").alias("doc_id"), F.col("raw").alias("raw_text"))


@query(f"""
    WITH {_PAGES},
    p AS (SELECT source, list_filter(list_transform(regexp_split_to_array(raw, '\\r\\n|[\\n\\r]'), lambda x: trim(x)), lambda x: x <> '') AS lines, {s.sql_collapse('raw')} AS t FROM pages_of),
    counted AS (
        SELECT source, count(*) AS physical_page_count, count(*) FILTER (length(t) < 80) AS missing_pages, sum(len(list_filter(lines, lambda x: length(x) <= 2))) / sum(len(lines)) < 0.25 AS order_ok,
               CAST(sum(length(t)) + count(*) - 1 AS BIGINT) AS read_chars FROM p GROUP BY source)
    SELECT *, concat_ws(',', CASE WHEN read_chars < 90000 THEN 'too_short' END, 'method_section_missing', CASE WHEN NOT order_ok THEN 'reading_order_uncertain' END,
           CASE WHEN missing_pages > 0 THEN 'missing_or_unreadable_pages' END) AS reasons FROM counted""")
def page_quality(spark, d):
    """Verdict on each source's pages; their only headings are results."""
    gate = fulltext.pdf_quality(fulltext.page_stats(_pages(spark, d)), 90_000)
    return gate.select(F.col("version_id").alias("source"), "physical_page_count", "missing_pages", "order_ok", "read_chars", F.array_join("reasons", ",").alias("reasons"))


@query("""
    SELECT conv_id, turn, 'section:' || coalesce(role, '') || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS locator
    FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n
          FROM (SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN role END AS role FROM conversations))""")
def section_numbering(spark, d):
    # Every third heading is unknown.
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 > 0, F.col("role")).alias("role"))
    return fulltext.number_occurrences(turns, ["conv_id"], "role", "turn").select("conv_id", "turn", "locator")


_CAPTIONS = """captions AS (SELECT l_orderkey, l_suppkey % 4 AS figure, l_partkey % 3 + 1 AS page FROM lineitem WHERE l_returnflag <> 'N'),
    needed AS (SELECT DISTINCT l_orderkey, l_suppkey % 4 AS figure FROM lineitem WHERE l_returnflag = 'A')"""


@query(f"""
    WITH {_CAPTIONS}, found AS (SELECT l_orderkey, figure, min(page) AS page, count(DISTINCT page) = 1 AS single FROM captions GROUP BY ALL)
    SELECT l_orderkey, count(DISTINCT CASE WHEN single THEN page END) AS visual_pages, CASE WHEN count(*) FILTER (single IS NOT TRUE) > 0 THEN 'html_figure_page_unlocated_or_ambiguous'
           WHEN count(DISTINCT page) > 1 THEN 'critical_visual_pages_exceed_limit' END AS error
    FROM needed LEFT JOIN found USING (l_orderkey, figure) GROUP BY l_orderkey""")
def figure_page_binding(spark, d):
    rows = table(spark, d, "lineitem")
    figure = (F.col("l_suppkey") % 4).cast("string")
    needed = rows.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("version_id"), F.concat(F.lit("Figure "), figure).alias("label")).distinct()
    captions = rows.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("version_id"), F.concat(F.lit("Fig. "), figure).alias("label"), (F.col("l_partkey") % 3 + 1).alias("page"))
    return fulltext.bind_figures(needed, captions, max_pages=1).withColumnRenamed("version_id", "l_orderkey")


@query("""
    WITH x AS (SELECT DISTINCT l_orderkey, l_partkey % 5 AS path, max(CAST(trunc(l_extendedprice * 100) AS BIGINT)) OVER (PARTITION BY l_orderkey, l_partkey % 5) AS bytes FROM lineitem)
    SELECT l_orderkey, CAST(sum(bytes) AS BIGINT) AS bytes, CASE WHEN count(*) FILTER (path = 4) > 0 THEN 'required_visual_missing' WHEN count(*) FILTER (path < 4 AND bytes > 8000000) > 0 THEN 'required_visual_invalid'
           WHEN sum(bytes) > 12000000 THEN 'required_visuals_too_large' END AS error FROM x GROUP BY l_orderkey""")
def image_selection(spark, d):
    images = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), (F.col("l_extendedprice") * 100).cast("long").alias("bytes"),
                                                F.when(F.col("l_partkey") % 5 == 4, "").otherwise((F.col("l_partkey") % 5).cast("string")).alias("path"))
    return fulltext.select_images(images, total=12_000_000).select(F.col("version_id").alias("l_orderkey"), "bytes", "error")


@query("SELECT CASE WHEN value < 50 THEN 'single_column_layout' WHEN value < 150 THEN 'two_column' ELSE 'ambiguous_columns' END AS strategy, count(*) AS pages FROM events GROUP BY 1")
def strategy_histogram(spark, d):
    v = F.col("value")
    return fulltext.strategy_histogram(table(spark, d, "events").select(F.when(v < 50, "single_column_layout").when(v < 150, "two_column").otherwise("ambiguous_columns").alias("strategy")))


@query("""
    WITH p AS (SELECT user_id, bool_or(event_type = 'click') AS pdf, bool_or(event_type = 'view') AS html, bool_or(event_type = 'signup') AS gone, bool_or(event_type = 'error' AND value > 340) AS failed
               FROM events GROUP BY user_id)
    SELECT bool_and(NOT failed AND pdf AND (html OR gone)) AS complete FROM p""")
def manifest_completeness(spark, d):
    kinds = F.when(F.col("event_type") == "click", "pdf").when(F.col("event_type").isin("view", "signup"), "html")
    # Each array holds at most two distinct kinds.
    pick = lambda test, value: F.collect_set(F.when(test, F.struct(value.alias("kind"))))
    papers = table(spark, d, "events").groupBy("user_id").agg(
        pick(F.col("event_type").isin("click", "view"), kinds).alias("sources"), pick(F.col("event_type") == "signup", kinds).alias("unavailable"),
        pick((F.col("event_type") == "error") & (F.col("value") > 340), F.lit("pdf")).alias("failures"))
    return fulltext.manifest_complete(papers)


@query("""
    SELECT doc_id, 'html' AS source_type, len(string_split(text, chr(10))) AS locators, doc_id % 2 = 0 AS rendered, doc_id % 3 = 0 AS required FROM documents""")
def body_metadata(spark, d):
    n = F.col("doc_id")
    figure = F.struct(F.lit("Figure 1").alias("label"), F.lit("caption:Figure 1").alias("locator"), F.col("source_url").alias("caption"),
                      F.when(n % 2 == 0, "page.png").otherwise("").alias("image_path"), (n % 3 == 0).alias("required"))
    body = F.struct(F.lit("v").alias("version_id"), F.col("source_url"), F.lit("html").alias("source_type"), F.col("sections"), F.array(figure).alias("figures"), F.lit(True).alias("quality"))
    public = _bodies(spark, d).withColumn("body", body).select("doc_id", state.body_metadata().alias("m"))
    return public.select("doc_id", "m.source_type", F.size("m.locators").alias("locators"), F.col("m.figures")[0]["rendered"].alias("rendered"), F.col("m.figures")[0]["required"].alias("required"))
