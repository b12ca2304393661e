import pytest

from scholarsieve.llm.html_text import extract, main_text, smooth, threshold

PARA = "Running text of the article that goes on for a while &amp; says <b>something</b> in whole sentences, again and again."
CLEAN = "Running text of the article that goes on for a while & says something in whole sentences, again and again."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("bare words", "bare words"), ("<p>one<p>two</div></b>three", "one two three"),
    (f"<article><h1>T</h1><p>{PARA}</p><p>Short.</p></article>", f"T {CLEAN} Short."),
    (f"<nav><a>Home</a></nav><header><h1>Site</h1></header><main><h1>T</h1><p>{PARA}</main><aside>{PARA}</aside><footer>{PARA}</footer>", f"T {CLEAN}"),
    (f"<div id=page><div class='menu'><a>x</a></div><div class=body><h1>T</h1><p>{PARA}</p><p>{PARA}</p></div><div class='comments'><p>{PARA}</p></div></div>", f"T {CLEAN} {CLEAN}"),
    (f"<article>{PARA}<div class='ad-box'>{PARA}</div><section id='cookieNotice'>{PARA}</section><form><p>{PARA}</p></form>tail&nbsp;end</article>", f"{CLEAN} tail end"),
    (f"<script>var t='</p><p>{PARA}</p>';</script><style>p{{}}</style><article><p>a<i>b</i>c&lt;d&gt;<!-- {PARA} --></p></article>", "abc<d>"),
    (f"<article><header><h1>T</h1></header><ul><li>first point<li>second point</ul><table><tr><td>cell</table><p>{PARA}</article>", f"T first point second point cell {CLEAN}"),
    (f"<article><p><b>{PARA}<br><p>next &#233; line</article>", f"{CLEAN} next é line"),
    (f"<div role=navigation>{PARA}</div><article><p hidden>{PARA}</p><p>{PARA}</p></article>", CLEAN),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_ratios_are_smoothed_and_split():
    import numpy as np
    values = np.array([0.1, 0.2, 5.0, 0.1, 6.0, 5.5, 0.1])
    assert abs(smooth(values).mean() - values.mean()) < 1 and 0.2 < threshold(values) < 5
    assert threshold(np.array([3.0, 3.0])) == 3.0


def test_every_page_has_a_row(spark):
    rows = [(1, "u", f"<article>{PARA * 300}</article>"), (1, None, None), (None, "v", ""), (4, "w", "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url")
    got = extract(pages).collect()
    assert sorted(r.n_chars for r in got) == sorted([0, 0, 0, len((CLEAN * 300))])
    assert all(r.n_chars == len(r.text) for r in got) and extract(pages.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark, sf):
    import html
    import re
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", sources[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(/?p|/?h1|br)>", " ", inner))).split())


LINKS = "".join(f"<li><a href=x>link number {i}</a></li>" for i in range(30))


@pytest.mark.parametrize("page, text", [
    (f"<html><head><title>T</title><meta charset=utf-8><body><article><p>{PARA}</p></article></body></html>", CLEAN),
    (f"<head><script>x</script><p>{PARA}<p>{PARA}", f"{CLEAN} {CLEAN}"),
    (f"<article class='node node--promoted'><p>{PARA}</p></article>", CLEAN),
    (f"<body><div class='has-sidebar'><div class=menu><p>Menu text</p></div><div><p>{PARA}</p><p>{PARA}</p></div></div>", f"{CLEAN} {CLEAN}"),
    (f"<div class='widget content'><p>{PARA}</p></div>", CLEAN),
    (f"<main><h1>T</h1><div class='widget content'><p>{PARA}</p></div></main>", f"T {CLEAN}"),
    (f"<main><div class='has-sidebar'><article><p>{PARA}</p></article><div class=sidebar>{PARA}</div></div></main>", CLEAN),
    (f"<body><form id=aspnetForm><input type=hidden><div><p>{PARA}</p></div></form></body>", CLEAN),
    (f"<article><p>{PARA}</p></article><div class=related><p>{PARA}</p><p>{PARA}</p></div>", CLEAN),
    (f"<div class=body><p>{PARA}</p></div><div class=comments>{f'<article><p>{PARA}</p></article>' * 20}</div>", CLEAN),
    (f"<article><p>One <span class=share>Share</span> two</p><p>{PARA}</p></article>", f"One two {CLEAN}"),
    (f"<article><p>{PARA * 9}</p><ul>{LINKS}</ul><p>{PARA * 9}</p></article>",
     " ".join([CLEAN * 9, *(f"link number {i}" for i in range(30)), CLEAN * 9])),
])
def test_names_forms_and_open_heads_lose_no_article(page, text):
    assert main_text(page) == text
