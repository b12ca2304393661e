"""Column functions over HTML markup: text, references, and the structure of an article, as built-in expressions.

Structure is read without a tree: the markup is split at the tags that matter, and a state machine with a stack of
open elements tells for each piece of text which section, table, figure and caption hold it. An end tag closes the
nearest open element of its name and all inside it; other end tags are ignored.
"""
from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from scholarsieve.functions.arrays import built_once, scan
from scholarsieve.functions.text import collapse, let

# Elements and classes outside the article text, and caption, end-matter, figure and identifier patterns.
DROPPED = ("script", "style", "nav", "header", "footer", "aside")
DROPPED_CLASSES = ("ltx_bibliography", "ltx_acknowledgements")
CAPTION_CLASS = "ltx_caption"
TABLE_FIGURE_CLASS = "ltx_table"
EQUATION_CLASSES = ("ltx_eqn", "ltx_equation")
CAPTION = (r"^\s*((?i:figure|fig\.?|table)\s*[A-Z]?\d+(?:[A-Za-z](?![A-Za-z]))?)"
           r"(?:\s*[:.\-]\s*\S.*|\s+(?=[A-Z])\S.*|(?=[A-Z][a-z])\S.*)$")
BODY_END = r"(?i)^(references|bibliography|acknowledg(?:e)?ments?)$"
KEY_VISUAL = (r"(?i)\b(table|result|performance|comparison|ablation|architecture|framework|topology|quantitative|"
              r"qualitative|visualization|pipeline)\b")
HTML_ID = r"^[A-Za-z][A-Za-z0-9_.:-]*$"
SECTION_TAG = r"(?i)<section\b"
STRUCTURED = r"(?i)<(?:section|figure|table)\b"
STRUCTURE_TAGS = ("section", "div", "h[1-6]", "table", "caption", "figure", "figcaption", *DROPPED[2:])
# Names of character references that are decoded besides numeric ones.
ENTITY_NAMES = ("lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "middot", "ndash", "mdash", "hellip", "lsquo", "rsquo", "ldquo", "rdquo", "laquo", "raquo",
                "times", "divide", "plusmn", "minus", "deg", "micro", "sect", "para", "euro", "pound", "trade", "bull", "le", "ge", "ne", "asymp", "infin",
                "rarr", "larr", "alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "pi", "sigma", "phi", "omega", "amp")
ENTITIES = tuple((f"&{name};", html5[f"{name};"]) for name in ENTITY_NAMES)
_SQL_MARKS = ",".join(mark.replace("'", "\\'") for _, mark in ENTITIES)


def _named(text: Column) -> Column:
    """Known names, the ampersand last, so that what it leaves is not decoded again; others stay."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(&[A-Za-z]+;)"), F.lit(1))))
    marks = F.expr(f"map_from_arrays(split('{' '.join(name for name, _ in ENTITIES)}', ' '), split('{_SQL_MARKS}', ','))")
    ordered = F.concat(F.array_remove(found, "&amp;"), F.array(F.lit("&amp;")))
    return F.aggregate(ordered, text, lambda done, name: F.replace(done, name, F.coalesce(F.element_at(marks, name), name)))


def _numeric(text: Column) -> Column:
    """Decimal and hexadecimal references; those of no character stay."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)"), F.lit(1)))

    def replace(done, reference):
        digits = F.regexp_extract(reference, "([0-9A-Fa-f]+);", 1)
        code = F.when(F.lower(reference).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        mark = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.replace(done, reference, F.coalesce(mark, reference))

    return F.aggregate(found, text, replace)


def references(text: Column) -> Column:
    """Character references decoded."""
    def decode(t):
        return F.when(F.contains(t, F.lit("&")), _named(F.when(F.contains(t, F.lit("&#")), _numeric(t)).otherwise(t))).otherwise(t)

    return let(text, decode)


def plain_text(markup: Column) -> Column:
    """Text of a piece of markup: tags part words, references are decoded."""
    return collapse(references(F.regexp_replace(markup, "(?s)<!--.*?-->|<[^>]*>", " ")))


def _inside(html: Column, tag: str) -> Column:
    """Markup behind the first start tag up to the next end tag of the name; null without one, or if it is empty."""
    begun = F.get(F.split(html, rf"(?i)<{tag}\b[^>]*>", 2), 1)
    return let(F.get(F.split(begun, rf"(?i)</{tag}\s*>", 2), 0), lambda inner: F.when(inner != "", inner))


def _root(html: Column) -> Column:
    return let(html, lambda h: F.coalesce(*(_inside(h, tag) for tag in ("article", "main", "body"))))


def _without(html: Column, tags) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return html


def article(html: Column) -> Column:
    """Inner markup of the article (else main, else body) without the dropped elements; null if there is none."""
    return _root(_without(html, DROPPED))


def undropped(body: Column) -> Column:
    """The article's inner markup without the dropped elements."""
    return _without(body, DROPPED[2:])


def structured_root(html: Column) -> Column:
    """Like `article`, but elements stay that the structure's own stack leaves out."""
    return _root(F.regexp_replace(_without(html, DROPPED[:2]), "(?s)<!--.*?-->", " "))


def headed_parts(body: Column) -> Column:
    """(name, text) of the paragraphs under each heading; those before the first one are the introduction.

    Paragraphs of figures are not the article's prose.
    """
    def part(markup):
        heading = F.regexp_extract(markup, r"(?is)^<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", 1)
        paragraphs = F.slice(F.split(markup, r"(?i)<p\b[^>]*>"), 2, 2**31 - 2)
        words = F.array_join(F.transform(paragraphs, lambda p: F.get(F.split(p, r"(?i)</p\s*>", 2), 0)), " ")
        return let(F.transform(F.array(heading, words), plain_text), lambda t: F.struct(
            F.when(F.get(t, 0) != "", F.get(t, 0)).otherwise("Introduction").alias("name"), F.get(t, 1).alias("text")))

    return F.transform(F.split(_without(body, ("figure",)), r"(?i)(?=<h[1-6]\b)"), part)


PLACE = "struct<name:string,left_out:boolean,section:int,path:array<int>,table:int,equation:int,figure:int,caption:int>"
PIECE = f"struct<place:{PLACE},opened:string,id:string,table_figure:boolean>"


def _attribute(tag: Column, name: str) -> Column:
    quoted = rf"(?is)^<[^>]*?\s{name}\s*=\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\s\"'>]+))"
    return F.concat(*(F.regexp_extract(tag, quoted, group) for group in (1, 2, 3)))


def _has_class(classes: Column, names, prefix: bool = False) -> Column:
    end = "" if prefix else r"(?=\s|$)"
    return classes.rlike(rf"(?:^|\s)(?:{'|'.join(names)}){end}")


def _move(state: Column, tag: Column) -> Column:
    """The machine's step: open or close one element."""
    def enter(top):
        left_out = top["left_out"] | tag["name"].isin(*DROPPED) | _has_class(tag["classes"], DROPPED_CLASSES)
        equation = _has_class(tag["classes"], EQUATION_CLASSES, prefix=True)
        is_a = lambda name: ~left_out & (tag["name"] == name)
        section, figure = is_a("section"), is_a("figure")
        table, formula = is_a("table") & ~equation, is_a("table") & equation
        caption = ~left_out & (top["caption"] == 0) & (tag["name"].isin("caption", "figcaption") | _has_class(tag["classes"], (CAPTION_CLASS,)))
        counted = {name: state[name] + test.cast("int") for name, test in
                   (("sections", section), ("tables", table), ("equations", formula), ("figures", figure), ("captions", caption))}
        place = F.struct(
            tag["name"].alias("name"), left_out.alias("left_out"), F.when(section, counted["sections"]).otherwise(top["section"]).alias("section"),
            F.when(section, F.concat(top["path"], F.array(counted["sections"]))).otherwise(top["path"]).alias("path"),
            F.when(table, counted["tables"]).otherwise(top["table"]).alias("table"), F.when(formula, counted["equations"]).otherwise(top["equation"]).alias("equation"),
            F.when(figure, counted["figures"]).otherwise(top["figure"]).alias("figure"), F.when(caption, counted["captions"]).otherwise(top["caption"]).alias("caption"))
        opened = F.when(formula, "equation").when(~left_out, tag["name"])
        return let(place, lambda p: F.struct(
            F.struct(F.concat(state["stack"], F.array(p)).alias("stack"), *(value.alias(name) for name, value in counted.items())).alias("state"),
            F.struct(p.alias("place"), opened.alias("opened"), tag["id"].alias("id"), _has_class(tag["classes"], (TABLE_FIGURE_CLASS,)).alias("table_figure")).alias("out")))

    def leave(stack):
        behind = F.array_position(F.reverse(F.transform(stack, lambda p: p["name"])), tag["name"]).cast("int")
        rest = F.when((behind > 0) & (tag["name"] != ""), F.slice(stack, F.lit(1), F.size(stack) - behind)).otherwise(stack)
        names = ("sections", "tables", "equations", "figures", "captions")
        return let(rest, lambda r: F.struct(
            F.struct(r.alias("stack"), *(state[name].alias(name) for name in names)).alias("state"),
            F.struct(F.element_at(r, -1).alias("place"), F.lit(None).cast("string").alias("opened"), F.lit("").alias("id"), F.lit(False).alias("table_figure")).alias("out")))

    return F.when(tag["open"], let(F.element_at(state["stack"], -1), enter)).otherwise(leave(state["stack"]))


@built_once
def pieces(body: str) -> Column:
    """Texts between structure tags with their places, in order; those of dropped elements are left out."""
    parts = F.split(F.col(body), rf"(?i)(?=</?(?:{'|'.join(STRUCTURE_TAGS)})(?![\w-]))")

    def read(markups):
        def tag(markup):
            opening = F.regexp_extract(markup, r"(?s)^<[^>]*>", 0)
            name = F.lower(F.regexp_extract(markup, rf"(?i)^</?({'|'.join(STRUCTURE_TAGS)})(?![\w-])", 1))
            attributes = F.when(F.contains(opening, F.lit("=")), opening).otherwise("")
            return let(attributes, lambda a: F.struct(
                name.alias("name"), ((name != "") & ~markup.startswith("</")).alias("open"), _attribute(a, "id").alias("id"), _attribute(a, "class").alias("classes")))

        none = F.lit(0)
        outside = F.struct(F.lit("").alias("name"), F.lit(False).alias("left_out"), none.alias("section"), F.array().cast("array<int>").alias("path"), none.alias("table"),
                           none.alias("equation"), none.alias("figure"), none.alias("caption"))
        start = F.struct(F.array(outside).alias("stack"), *(none.alias(name) for name in ("sections", "tables", "equations", "figures", "captions")))
        placed = F.arrays_zip(scan(F.transform(markups, tag), start, _move, PIECE).alias("at"), markups.alias("markup"))
        kept = F.filter(F.transform(placed, lambda x, i: F.struct(i.alias("pos"), x["at"].alias("at"), x["markup"].alias("markup"))), lambda x: ~x["at"]["place"]["left_out"])
        return F.transform(kept, lambda x: F.struct(
            x["pos"].alias("pos"), x["at"]["opened"].alias("opened"), x["at"]["id"].alias("id"), x["at"]["table_figure"].alias("table_figure"),
            *(x["at"]["place"][name].alias(name) for name in ("section", "path", "table", "equation", "figure", "caption")),
            plain_text(x["markup"]).alias("text")))

    return let(parts, read)


@built_once
def pieces_of_structured(body: str) -> Column:
    """Pieces of a page with sections, figures or tables; null for others."""
    return F.when(F.col(body).rlike(STRUCTURED), pieces(body))
