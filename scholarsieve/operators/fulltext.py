"""Full-text sections, quality gate, chunks and reading budget."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholarsieve.functions import arrays, markup
from scholarsieve.functions.text import SPACES, blank, collapse, let, strip
from scholarsieve.operators import ranking
from scholarsieve.operators.rules import once
from scholarsieve.session import sized

# Heading patterns of the quality gate.
METHOD = r"(?i)\b(methods?|methodology|approach|framework|algorithm|model|objective|optimization|theor(?:y|em)s?|proof)\b"
EVALUATION = r"(?i)\b(experiments?|evaluation|results?|benchmark|ablation|analysis|discussion|proof|theor(?:y|em)s?)\b"
NOT_METHOD = r"(?i)introduction|related work|experiment|evaluation|result|discussion|conclusion"
METHOD_PROSE = r"(?i)\b(overall architecture|model architecture|proposed framework|proposed model|our method|our approach)\b"
SHORT_HEADING = (r"(?i)^(?:(?:materials?\s+(?:and|&)\s+)?methods?|methodology|approach|framework|experiments?|"
                 r"experimental\s+(?:results?|evaluation|setup)|evaluation|results?|theory|theoretical\s+analysis|proof|appendix)$")
NUMBERED_HEADING = r"^\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z0-9\s,:/()\-]{2,74}$"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


LEAST_SECTION = 40
LEAST_TABLE = 12
_SECTIONS = "array<struct<locator:string,text:string,kind:string>>"
_FIGURES = "array<struct<label:string,locator:string,caption:string,required:boolean>>"


def read_html(pages: DataFrame, *keys: str) -> DataFrame:
    """One body row per page: its sections (locator, text, kind), captioned figures and tables, and an error.

    Pages with section elements: each section gives its own text under its headings' lineage ("Methods / Training"),
    without its subsections, and each data table its caption and cells; displayed equations, which come as tables,
    follow their section's prose. Other pages: paragraphs under each heading. Short sections and end matter are left
    out, and later uses of a name get '#2', '#3', ... A figure inside a figure and a table inside a table own what
    they hold. All of it is built-in expressions over the page's own row, and each stage is evaluated once.
    """
    read = pages.select(*keys, once(markup.structured_root(F.col("html"))).alias("_body"))
    read = read.withColumns({"_pieces": once(markup.pieces_of_structured("_body")), "_flat": once(_flat_sections("_body"))})
    read = read.withColumn("_tables", once(_tables("_pieces")))
    sections = F.when(F.col("_flat").isNull(), _nested_sections("_pieces", "_tables")).otherwise(F.col("_flat"))
    return read.select(*keys, F.coalesce(sections, F.array().cast(_SECTIONS)).alias("sections"),
                       F.coalesce(_captioned("_pieces", "_tables"), F.array().cast(_FIGURES)).alias("figures"),
                       F.when(F.col("_body").isNull(), "html_body_missing").alias("error"))


def _section(name: Column, use: Column, text: Column) -> Column:
    locator = F.concat(F.lit("section:"), name, F.when(use > 1, F.concat(F.lit("#"), use.cast("string"))).otherwise(""))
    return F.struct(locator.alias("locator"), text.alias("text"), F.lit("section").alias("kind"))


@arrays.built_once
def _flat_sections(body: str) -> Column:
    """Sections of a page without section elements; null for others."""
    def numbered(kept):
        uses = arrays.occurrence_numbers(F.transform(kept, lambda p: p["name"]))
        return let(uses, lambda n: F.transform(kept, lambda p, i: _section(p["name"], F.get(n, i), p["text"])))

    parts = markup.headed_parts(markup.undropped(F.col(body)))
    kept = F.filter(parts, lambda p: (F.length(p["text"]) >= LEAST_SECTION) & ~p["name"].rlike(markup.BODY_END))
    return F.when(~F.col(body).rlike(markup.SECTION_TAG), let(kept, numbered))


def _by(pieces, owner: str) -> Column:
    """Pieces of each section, table or figure, in their numbers' order."""
    owned = F.filter(pieces, lambda x: x[owner] > 0) if owner != "section" else pieces
    keyed = F.array_sort(F.transform(owned, lambda x: F.struct(x[owner].alias("owner"), x["pos"].alias("pos"), x.alias("x"))))
    return F.transform(arrays.runs(keyed, lambda k: k["owner"]), lambda run: F.transform(run, lambda k: k["x"]))


def _text(pieces: Column) -> Column:
    """Texts of pieces, joined like one piece of markup."""
    return F.array_join(F.filter(F.transform(pieces, lambda x: x["text"]), lambda t: t != ""), " ")


def _first_caption(pieces: Column) -> Column:
    """Text of the first caption among pieces; null without one."""
    held = F.filter(pieces, lambda x: x["caption"] > 0)
    return let(held, lambda h: F.when(F.size(h) > 0, _text(F.filter(h, lambda x: x["caption"] == F.get(h, 0)["caption"]))))


def _figures_of(pieces: str) -> Column:
    """Own caption and identity of each figure element, by number."""
    def figure(run):
        opening = F.get(run, 0)
        return F.struct(opening["pos"].alias("pos"), opening["id"].alias("id"), opening["table_figure"].alias("table_figure"),
                        _first_caption(F.filter(run, lambda x: x["table"] == 0)).alias("caption"))

    return F.transform(_by(F.col(pieces), "figure"), figure)


@arrays.built_once
def _tables(pieces: str) -> Column:
    """Data tables by number: label, locator, caption, value, and the section path and figure that hold them."""
    return F.when(F.col(pieces).isNotNull(), let(_figures_of(pieces), lambda figures: _tables_of(pieces, figures)))


def _tables_of(pieces: str, figures: Column) -> Column:
    def table(run, i):
        opening = F.get(run, 0)
        holder = F.when(opening["figure"] > 0, F.get(figures, opening["figure"] - 1))
        caption = F.coalesce(_first_caption(run), F.when(holder["table_figure"], holder["caption"]), F.lit(""))

        def identified(caption):
            numbered = F.when(F.lower(caption).startswith("table"), caption_label(caption))
            marker = F.coalesce(F.nullif(opening["id"], F.lit("")), holder["id"], F.lit(""))
            plain = ~marker.rlike(markup.HTML_ID)
            ordinal = (i + 1).cast("string")
            label = F.coalesce(numbered, F.when(plain, F.concat(F.lit("HTML table node "), ordinal)).otherwise(F.concat(F.lit("HTML table id "), marker)))
            name = F.coalesce(numbered, F.when(plain, F.concat(F.lit("html-node:"), ordinal)).otherwise(F.concat(F.lit("html-id:"), marker)))
            return F.struct(opening["pos"].alias("pos"), opening["path"].alias("path"), opening["figure"].alias("figure"), label.alias("label"), name.alias("name"),
                            caption.alias("caption"), collapse(F.concat_ws(" ", caption, _text(run))).alias("text"))

        return let(caption, identified)

    return F.transform(_by(F.col(pieces), "table"), table)


@arrays.built_once
def _nested_sections(pieces: str, tables: str) -> Column:
    """Sections and data tables of a page with section elements, in the order of their elements."""
    def own(run):
        heading = F.get(F.filter(run, lambda x: x["opened"].rlike("^h[1-6]$")), 0)["text"]
        opening = F.get(run, 0)
        prose = _text(F.filter(run, lambda x: (x["table"] == 0) & (x["equation"] == 0)))
        formulas = F.array_join(F.transform(
            F.filter(run, lambda x: (x["table"] == 0) & (x["equation"] > 0) & (x["text"] != "")),
            lambda x: F.concat(F.when(x["opened"] == "equation", " ; ").otherwise(" "), x["text"])), "")
        text = F.concat(prose, F.when(formulas != "", F.concat(F.lit(" Equations: "), F.regexp_replace(formulas, "^[ ;]+", ""))).otherwise(""))
        return F.struct(opening["pos"].alias("pos"), opening["path"].alias("path"), F.coalesce(heading, collapse(opening["id"]), F.lit("")).alias("heading"), text.alias("text"))

    def lineage(path, found):
        # Sections are numbered from 1; text outside of them comes first.
        return F.filter(F.transform(path, lambda k: F.get(found, k)["heading"]), lambda name: name != "")

    def entries(found):
        ends = lambda path: F.exists(lineage(path, found), lambda name: name.rlike(markup.BODY_END))
        sections = F.transform(F.filter(found, lambda s: (F.size(s["path"]) > 0) & ~ends(s["path"])), lambda s: F.struct(
            s["pos"].alias("pos"), F.lit("section").alias("kind"), F.array_join(lineage(s["path"], found), " / ").alias("name"), s["text"].alias("text")))
        held = F.transform(F.filter(F.col(tables), lambda t: ~ends(t["path"]) & (F.length(t["text"]) >= LEAST_TABLE)), lambda t: F.struct(
            t["pos"].alias("pos"), F.lit("table").alias("kind"), t["name"].alias("name"), t["text"].alias("text")))

        def numbered(s):
            uses = arrays.occurrence_numbers(F.transform(s, lambda x: x["name"]))
            return let(uses, lambda n: F.transform(s, lambda x, i: F.struct(*(x[c].alias(c) for c in ("pos", "kind", "name", "text")), F.get(n, i).alias("use"))))

        plain = F.transform(held, lambda t: F.struct(*(t[c].alias(c) for c in ("pos", "kind", "name", "text")), F.lit(1).alias("use")))
        accepted = F.filter(F.array_sort(F.concat(let(sections, numbered), plain)), lambda x: (x["kind"] == "table") | (F.length(x["text"]) >= LEAST_SECTION))

        def entry(x, i):
            unnamed = F.concat(F.lit("Unnamed "), (i + 1).cast("string"))
            section = F.when(x["name"] == "", _section(unnamed, F.lit(1), x["text"])).otherwise(_section(x["name"], x["use"], x["text"]))
            return F.when(x["kind"] == "section", section).otherwise(
                F.struct(F.concat(F.lit("table:"), x["name"]).alias("locator"), x["text"].alias("text"), F.lit("table").alias("kind")))

        return F.transform(accepted, entry)

    return let(F.transform(_by(F.col(pieces), "section"), own), entries)


@arrays.built_once
def _captioned(pieces: str, tables: str) -> Column:
    """Captioned figures and tables of a page, in the order of their elements."""
    shape = "array<struct<pos:int,table:boolean,name:string,label:string,caption:string>>"

    def entries(figures):
        alone = F.transform(F.filter(F.col(tables), lambda t: t["figure"] == 0), lambda t: F.struct(
            t["pos"].alias("pos"), F.lit(True).alias("table"), t["name"].alias("name"), t["label"].alias("label"), t["caption"].alias("caption")))
        first = F.transform(arrays.runs(F.array_sort(F.transform(F.filter(F.col(tables), lambda t: t["figure"] > 0), lambda t: F.struct(
            t["figure"].alias("figure"), t["pos"].alias("pos"), t["name"].alias("name"), t["label"].alias("label"), t["caption"].alias("caption")))),
            lambda t: t["figure"]), lambda run: F.get(run, 0))
        with_table = F.transform(first, lambda t: F.struct(
            F.get(figures, t["figure"] - 1)["pos"].alias("pos"), F.lit(True).alias("table"), t["name"].alias("name"), t["label"].alias("label"), t["caption"].alias("caption")))
        owners = F.transform(first, lambda t: t["figure"])
        no_label = F.lit(None).cast("string")
        others = let(owners, lambda o: F.transform(F.filter(F.transform(figures, lambda f, i: F.struct(f.alias("f"), (i + 1).alias("n"))), lambda x: ~F.array_contains(o, x["n"])), lambda x: F.struct(
            x["f"]["pos"].alias("pos"), F.lit(False).alias("table"), no_label.alias("name"), caption_label(x["f"]["caption"]).alias("label"), x["f"]["caption"].alias("caption"))))
        listed = F.filter(F.array_sort(F.concat(alone.cast(shape), with_table.cast(shape), others.cast(shape))), lambda x: F.when(x["table"], x["caption"] != "").otherwise(x["caption"].isNotNull()))

        def entry(x, i):
            label = F.coalesce(x["label"], F.concat(F.lit("figure "), (i + 1).cast("string")))
            locator = F.concat(F.lit("caption:"), F.when(x["table"], x["name"]).otherwise(label))
            required = ~x["table"] & ~F.lower(label).startswith("table") & x["caption"].rlike(markup.KEY_VISUAL)
            return F.struct(label.alias("label"), locator.alias("locator"), x["caption"].alias("caption"), required.alias("required"))

        return F.transform(listed, entry)

    return F.when(F.col(pieces).isNotNull(), let(_figures_of(pieces), entries))


def sections(bodies: DataFrame, *keys: str) -> DataFrame:
    return bodies.select(*keys, F.posexplode("sections").alias("pos", "s")).select(*keys, "pos", "s.*")


def quality(min_chars: int, source_type: Column, order_ok: Column | None = None, missing_pages: Column | None = None) -> Column:
    """Gate of a body from its `sections` array: verdict, reasons and counts."""
    filled = F.filter("sections", lambda s: ~blank(s["text"]))
    headings = F.array_join(F.transform(filled, lambda s: s["locator"]), " ")
    words = F.array_join(F.transform(filled, lambda s: s["text"]), " ")
    prose = F.exists(filled, lambda s: (s["kind"] == "section") & ~s["locator"].rlike(NOT_METHOD)
                     & F.substring(s["text"], 1, 300).rlike(METHOD_PROSE))
    method = headings.rlike(METHOD) | ((source_type == "html") & prose)
    evaluation = headings.rlike(EVALUATION)
    length = F.length(words)
    broken = F.length(words) - F.length(F.replace(words, F.lit("�"), F.lit("")))
    order_ok = F.lit(True) if order_ok is None else order_ok
    missing = F.lit(0) if missing_pages is None else missing_pages
    reasons = F.array_compact(F.array(
        F.when(length < min_chars, "too_short"), F.when(F.size(filled) < 2, "no_section_structure"),
        F.when(~method, "method_section_missing"), F.when(~evaluation, "evaluation_or_theory_section_missing"),
        F.when(~order_ok, "reading_order_uncertain"), F.when(missing > 0, "missing_or_unreadable_pages"),
        F.when((length > 0) & (broken / length > 0.001), "replacement_glyphs")))
    return F.struct((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"), F.size(filled).alias("section_count"),
                    length.alias("read_chars"), F.transform(filled, lambda s: s["locator"]).alias("read_locators"),
                    method.alias("has_method"), evaluation.alias("has_evaluation_or_theory"))


def choose_body(html: DataFrame, pdf: DataFrame) -> DataFrame:
    """HTML when it passes, else PDF when that passes, else both failures are reported.

    Inputs: version_id, body (struct), quality (struct with passed and reasons).
    """
    h, p = html.alias("h"), pdf.alias("p")
    ok = lambda side: F.coalesce(F.col(f"{side}.quality.passed"), F.lit(False))
    why = F.when(F.col("h.version_id").isNull(), "html_unavailable").otherwise(F.array_join("h.quality.reasons", ","))
    return h.join(p, F.col("h.version_id") == F.col("p.version_id"), "full_outer").select(
        F.coalesce("h.version_id", "p.version_id").alias("version_id"),
        F.when(ok("h"), "html").when(ok("p"), "pdf").alias("source_type"),
        F.when(ok("h"), F.col("h.body")).when(ok("p"), F.col("p.body")).alias("body"),
        F.when(~ok("h"), why).alias("html_fallback_reason"),
        F.when(~ok("h") & ~ok("p"), F.when(F.col("p.version_id").isNull(), "source_unavailable")
               .otherwise(F.concat(F.lit("fulltext_quality_failed:"), F.array_join("p.quality.reasons", ",")))).alias("error"))


def accept_body(records: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies that pass the gate and belong to exactly the record's version."""
    joined = records.join(bodies.select("base_id", F.col("version_id").alias("body_version"), "qualified"), "base_id", "left")
    fits = F.col("qualified") & (F.col("version_id") == F.col("body_version"))
    return joined.withColumn("error", F.when(F.col("body_version").isNull(), "fulltext_missing")
                             .when(~F.coalesce(fits, F.lit(False)), "fulltext_gate_or_version_failed"))


def _filled(line: Column) -> Column:
    return line.rlike(f"[^{SPACES}]")


def pdf_heading(line: Column) -> Column:
    """The collapsed line when it looks like a section heading, else null."""
    value = collapse(line)
    heading = ~value.rlike("[.;,]$") & (value.rlike(SHORT_HEADING) | value.rlike(NUMBERED_HEADING))
    # Prose lines end in punctuation: they are dismissed before the regular expressions.
    return F.when(~F.substring(F.rtrim(line), -1, 1).isin("", ".", ";", ","), F.when(heading, value))


def _edge_lines(raw: Column) -> Column:
    lines = F.filter(F.split(raw, LINE_BREAK), _filled)
    n = F.size(lines)
    last = F.slice(lines, F.greatest(n - 1, F.lit(1)), F.lit(2))
    return F.array_distinct(F.transform(F.concat(F.slice(lines, 1, 2), last), collapse))


def repeated_margins(pages: DataFrame, doc: str = "version_id") -> DataFrame:
    """Running headers and footers: edge lines on at least 2 and half of the pages.

    Rows: doc, page, raw. Pages are single rows, so per-page distinct needs no
    shuffle; counts combine on the map side.
    """
    edges = pages.select(doc, F.explode(_edge_lines(F.col("raw"))).alias("line"))
    totals = pages.groupBy(doc).agg(F.count("*").alias("pages"))
    counted = edges.groupBy(doc, "line").agg(F.count("*").alias("on_pages"))
    keep = ((F.col("on_pages") >= 2) & (F.col("on_pages") * 2 >= F.col("pages")) & F.length("line").between(4, 100)
            & pdf_heading(F.col("line")).isNull())
    return counted.where("on_pages >= 2").join(sized(totals), doc).where(keep)


def drop_margins(pages: DataFrame, margins: DataFrame, doc: str = "version_id") -> DataFrame:
    """Remove repeated margins. A document has at most 8 of them (4 edges per page, on
    half of the pages), so gathering them per document is bounded."""
    per_doc = margins.groupBy(doc).agg(F.collect_set("line").alias("_margins"))
    lines = F.split("raw", LINE_BREAK)
    kept = F.filter(lines, lambda x: ~F.array_contains("_margins", collapse(x)))
    joined = pages.join(sized(per_doc), doc, "left")
    return joined.withColumn("raw", F.when(F.col("_margins").isNull(), F.col("raw")).otherwise(F.array_join(kept, "\n"))).drop("_margins")


def page_stats(pages: DataFrame, doc: str = "version_id") -> DataFrame:
    """Line and heading statistics of extracted pages for the PDF gate."""
    filled = F.filter(F.transform(F.split("raw", LINE_BREAK), strip), lambda x: x != "")
    heads = F.filter(F.transform(F.split("raw", LINE_BREAK), pdf_heading), lambda x: x.isNotNull())
    rows = pages.withColumn("_text", once(collapse(F.col("raw")))).select(doc, "page", F.size(filled).alias("lines"), F.size(F.filter(filled, lambda x: F.length(x) <= 2)).alias("short"),
                        (F.length("_text") < 80).alias("missing"), F.array_join(heads, " ").alias("heads"), F.length("_text").alias("chars"),
                        (F.length("_text") - F.length(F.replace("_text", F.lit("\ufffd"), F.lit("")))).alias("broken"))
    first = F.col("page") == 1
    return rows.groupBy(doc).agg(
        F.count("*").alias("physical_page_count"), F.count_if("missing").alias("missing_pages"), F.count_if(F.col("chars") > 0).alias("filled_pages"),
        # Pages are joined by one blank.
        (F.sum("chars") + F.greatest(F.count_if(F.col("chars") > 0) - 1, F.lit(0))).alias("read_chars"), F.sum("broken").alias("broken_glyphs"),
        ((F.sum("lines") > 0) & (F.sum("short") / F.nullif(F.sum("lines"), F.lit(0)) < 0.25)).alias("order_ok"),
        F.coalesce(F.bool_or(F.col("heads").rlike(METHOD)), F.lit(False)).alias("has_method"),
        F.coalesce(F.bool_or(F.col("heads").rlike(EVALUATION)), F.lit(False)).alias("has_evaluation_or_theory"),
        F.coalesce(F.bool_or(first & F.col("heads").rlike(METHOD)), F.lit(False)).alias("method_on_first_page"),
        F.coalesce(F.bool_or(first & F.col("heads").rlike(EVALUATION)), F.lit(False)).alias("evaluation_on_first_page"))


def pdf_quality(stats: DataFrame, min_chars: int) -> DataFrame:
    """Gate of extracted pages from their statistics (`page_stats`): every page is a section of its own, and headings
    inside pages stand for section names; a single page with both needs no further structure. Adds passed and reasons."""
    both = F.col("has_method") & F.col("has_evaluation_or_theory")
    reasons = F.array_compact(F.array(
        F.when(F.col("read_chars") < min_chars, "too_short"),
        F.when((F.col("filled_pages") < 2) & ~(both & (F.col("physical_page_count") == 1)), "no_section_structure"),
        F.when(~F.col("has_method"), "method_section_missing"), F.when(~F.col("has_evaluation_or_theory"), "evaluation_or_theory_section_missing"),
        F.when(~F.col("order_ok"), "reading_order_uncertain"), F.when(F.col("missing_pages") > 0, "missing_or_unreadable_pages"),
        F.when(F.col("broken_glyphs") > 0.001 * F.col("read_chars"), "replacement_glyphs")))
    return stats.withColumns({"reasons": reasons, "passed": F.size(reasons) == 0})


def caption_label(line: Column) -> Column:
    """'Figure 3', 'Table S1', ... at the start of a caption line, else null."""
    found = F.regexp_extract(line, markup.CAPTION, 1)
    return F.when(found != "", collapse(found))


def label_key(label: Column) -> Column:
    folded = F.regexp_replace(F.lower(label), f"[{SPACES}]+", "")
    return F.regexp_replace(folded, r"^(?:figure|fig\.?)", "figure")


def number_occurrences(df: DataFrame, doc: list[str], name: str, pos: str) -> DataFrame:
    """Second and later uses of a heading in a document get '#2', '#3', ..."""
    counted = ranking.running_totals(df.withColumn("_at", ranking.key(pos)), [*doc, name], "_at", {"occurrence": F.lit(1).cast("long")})
    suffix = F.when(F.col("occurrence") > 1, F.concat(F.lit("#"), F.col("occurrence"))).otherwise("")
    return counted.drop("_at").withColumn("locator", F.concat(F.lit("section:"), F.coalesce(name, F.lit("")), suffix))


def bind_figures(required: DataFrame, captions: DataFrame, max_pages: int) -> DataFrame:
    """Match required HTML figures to the one PDF page whose caption has the same label."""
    keyed = required.withColumn("key", label_key(F.col("label")))
    pages = (captions.withColumn("key", label_key(F.col("label"))).groupBy("version_id", "key")
             .agg(F.min("page").alias("page"), (F.min("page") == F.max("page")).alias("single")))
    bound = keyed.join(pages, ["version_id", "key"], "left").withColumn("page", F.when(F.col("single"), F.col("page")))
    verdict = bound.groupBy("version_id").agg(F.count_if(F.col("page").isNull()).alias("_open"), F.count_distinct("page").alias("visual_pages"))
    error = (F.when(F.col("_open") > 0, "html_figure_page_unlocated_or_ambiguous")
             .when(F.col("visual_pages") > max_pages, "critical_visual_pages_exceed_limit"))
    return verdict.select("version_id", "visual_pages", error.alias("error"))


def select_images(images: DataFrame, each: int = 8_000_000, total: int = 24_000_000) -> DataFrame:
    """Verdict per version on its required images (version_id, path, bytes, pos):
    repeated paths count once, and size limits hold for each and for all."""
    first = images.groupBy("version_id", "path").agg(F.max("bytes").alias("bytes"))
    missing = F.count_if((F.coalesce("path", F.lit("")) == ""))
    invalid = F.count_if((F.coalesce("path", F.lit("")) != "") & ((F.col("bytes").isNull()) | (F.col("bytes") > each)))
    totals = first.groupBy("version_id").agg(missing.alias("_m"), invalid.alias("_i"), F.sum("bytes").alias("bytes"),
                                             F.count("*").alias("images"))
    error = (F.when(F.col("_m") > 0, "required_visual_missing").when(F.col("_i") > 0, "required_visual_invalid")
             .when(F.col("bytes") > total, "required_visuals_too_large"))
    return totals.select("version_id", "images", "bytes", error.alias("error"))


def chunk_cap(chunk_chars: int, input_chars: int) -> int:
    if input_chars <= 768:
        raise ValueError("summary input too small")
    return max(256, min(chunk_chars, input_chars - 512))


def _last(text: Column, mark: str) -> Column:
    """Characters before the last use of a mark; -1 without one."""
    behind = F.instr(F.reverse(text), mark[::-1])
    return F.when(behind > 0, F.length(text) - behind - len(mark) + 1).otherwise(-1)


def _pieces(section: Column, cap: int) -> Column:
    """A section's text in pieces of at most `cap` characters.

    A piece ends one character into its last sentence or word mark when that lies beyond the middle, so every
    piece but the last is longer than half the cap: that bounds the steps.
    """
    text = F.coalesce(section["text"], F.lit(""))

    def step(start, _):
        window = F.substring(text, start + 1, F.lit(cap))
        mark = F.greatest(*(_last(window, m) for m in (". ", "。", " ")))
        size = F.when((start + cap < F.length(text)) & (mark > cap // 2), mark + 1).otherwise(F.length(window))
        return F.struct((start + size).alias("state"), F.struct(start.alias("start"), size.alias("size")).alias("out"))

    steps = F.sequence(F.lit(0), (F.length(text) / (cap // 2)).cast("int"))
    cuts = F.filter(arrays.scan(steps, F.lit(0), step, "struct<start:int,size:int>"), lambda c: c["size"] > 0)
    return F.transform(cuts, lambda c: F.struct(section["locator"].alias("locator"), F.substring(text, c["start"] + 1, c["size"]).alias("text")))


def _packed(cap: int) -> Column:
    """Pieces (chunk, locator, text) of a body's `sections`: they fill a chunk in order until the next one would pass the cap."""
    def pack(state, piece):
        size = F.length(piece["text"])
        full = (state["size"] > 0) & (state["size"] + size > cap)
        chunk = state["chunk"] + full.cast("int")
        return F.struct(F.struct(chunk.alias("chunk"), F.when(full, size).otherwise(state["size"] + size).alias("size")).alias("state"),
                        F.struct(chunk.alias("chunk"), piece["locator"].alias("locator"), piece["text"].alias("text")).alias("out"))

    pieces = F.flatten(F.transform(F.coalesce("sections", F.array().cast(_SECTIONS)), lambda x: _pieces(x, cap)))
    first = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("size"))
    return arrays.scan(pieces, first, pack, "struct<chunk:int,locator:string,text:string>")


def chunks(bodies: DataFrame, cap: int, *keys: str) -> DataFrame:
    """Chunk pieces (chunk, seq, locator, text) of every body's sections."""
    return bodies.select(*keys, F.posexplode(_packed(cap)).alias("seq", "c")).select(*keys, "seq", "c.*")


def _spaced_json(value: Column, separators: Column) -> Column:
    """Length of a value as JSON with a blank behind each of its separators; nulls are written out."""
    return F.length(F.to_json(value, {"ignoreNullFields": "false"})) + separators


def _commas(values: Column) -> Column:
    return F.greatest(F.size(values) - 1, F.lit(0))


def reading_context(bodies: DataFrame, input_chars: int, evidence_on: bool, chunk_chars: int = 12_000, max_section_calls: int = 64) -> Column:
    """How a body reaches the model: whole, as notes on its chunks, or not at all, and then why.

    Measured is all that is sent: address, sections, captions with their pages, and the locators that were read. A body
    may have `figures` (label, locator, caption) and `figure_pages` (label to page). Notes take one call per chunk.
    """
    columns = bodies.columns
    no_figures = F.array().cast("array<struct<label:string,locator:string,caption:string>>")
    figures = F.coalesce("figures", no_figures) if "figures" in columns else no_figures
    page = lambda label: F.try_element_at("figure_pages", label) if "figure_pages" in columns else F.lit(None).cast("int")

    def measured(captions):
        covered = F.transform(F.filter("sections", lambda s: ~blank(s["text"])), lambda s: s["locator"])
        texts = F.transform("sections", lambda s: F.struct(s["locator"].alias("locator"), s["text"].alias("text")))
        context = F.struct("source_url", texts.alias("sections"), captions.alias("captions"), covered.alias("coverage"))
        # An object of k fields has 2k - 1 separators.
        separators = 7 + 3 * F.size("sections") + _commas(F.col("sections")) + 7 * F.size(captions) + _commas(captions) + _commas(covered)
        return _spaced_json(context, separators)

    captions = F.transform(figures, lambda f: F.struct(f["locator"].alias("locator"), f["label"].alias("label"), f["caption"].alias("caption"), page(f["label"]).alias("pdf_physical_page")))
    fits = let(captions, measured) <= input_chars
    if not evidence_on:
        return F.when(fits, "direct").otherwise("fulltext_exceeds_direct_input_limit")
    calls = F.coalesce(F.element_at(F.transform(_packed(chunk_cap(chunk_chars, input_chars)), lambda c: c["chunk"]), -1) + 1, F.lit(0))
    return F.when(fits, "direct").when(calls > max_section_calls, "section_call_limit_exceeded").otherwise("chunk_notes")


def chunk_key(*, prompt_fingerprint: str, settings: dict) -> Column:
    """Content-addressed cache key of a chunk: prompt, model settings and content."""
    fixed = {f"a_{k}": F.lit(str(settings[k])) for k in sorted(settings)}
    return F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in fixed.items()), F.lit(prompt_fingerprint).alias("b_prompt"),
                                     F.col("version_id"), F.col("source_url"), F.col("sections"))), 256)


def uncached(chunk_rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose notes still have to be asked for."""
    return chunk_rows.join(cache.select("chunk_key"), "chunk_key", "left_anti")


def strategy_histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy("strategy").agg(F.count("*").alias("pages"))


def manifest_complete(papers: DataFrame) -> DataFrame:
    """All papers without failures, with a PDF, and with HTML or a note that it is unavailable."""
    has = lambda column, kind: F.exists(column, lambda s: s["kind"] == kind)
    whole = (F.size("failures") == 0) & has("sources", "pdf") & (has("sources", "html") | has("unavailable", "html"))
    return papers.agg(F.coalesce(F.bool_and(whole), F.lit(True)).alias("complete"))
