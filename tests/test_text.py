"""Folding, phrases, escapes and identifiers against plain Python models."""
import html
import re
import unicodedata

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from scholarsieve.functions import clock, delivery, ids, text

SAMPLES = [
    "plain ASCII  text\n\nwith\ttabs - and dashes", "Straße STRASSE ﬁne", "ＣＴ scan １２", "中CT文 CT", "étude É", "a b c", "x‑y–z—w", "\x0bodd\x1cspace\x85end",
    "“quoted” ‘text’", "İstanbul ſ K", "", "   ", "…dots ½", "no　break", "tab\tend\t", "---", "a - - b",
]


def rows(spark, values, *columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r for r in frame.select("i", *columns).orderBy("i").collect()]


def test_match_and_quote_forms_equal_the_python_model(spark):
    got = rows(spark, SAMPLES, text.match_form(F.col("t")).alias("m"), text.quote_form(F.col("t")).alias("q"), text.collapse(F.col("t")).alias("c"))
    for value, r in zip(SAMPLES, got):
        folded = unicodedata.normalize("NFKC", value).casefold()
        assert r.m == " ".join(re.sub("[‐-―−﹘﹣－-]", " ", folded).split())
        assert r.q == " ".join(folded.split())
        assert r.c == " ".join(value.split())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=30, max_size=60))
def test_forms_on_arbitrary_text(spark, values):
    # Letters newer than the JVM's Unicode tables may fold differently; they are not tested here.
    values = [v for v in values if all(unicodedata.category(c) != "Cn" for c in v)]
    got = rows(spark, values, text.match_form(F.col("t")).alias("m"), text.collapse(F.col("t")).alias("c"))
    assert [r.m for r in got] == [text.match_form_of(v) for v in values]
    assert [r.c for r in got] == [" ".join(v.split()) for v in values]


def test_phrases_need_word_edges_in_any_script(spark):
    cases = {"CT scan": True, "setup of acts": False, "中CT文": False, "x-CT.": True, "_CT_": False, "ct2": False, "the CT-scan": True}
    got = rows(spark, list(cases), text.has_phrase(text.match_form(F.col("t")), ["CT", "no such phrase"]).alias("hit"))
    assert [r.hit for r in got] == list(cases.values())
    assert rows(spark, ["anything"], text.has_phrase(F.col("t"), ["--", " "]).alias("hit"))[0].hit is False
    dashes = rows(spark, ["vision–language  model", "vision language models"], text.has_phrase(text.match_form(F.col("t")), ["vision-language model"]).alias("hit"))
    assert [r.hit for r in dashes] == [True, False]


def test_many_phrases_use_one_pattern(spark):
    phrases = [f"word{i} part" for i in range(30)]
    got = rows(spark, ["has word7 part.", "word7 parts"], text.has_phrase(F.col("t"), phrases).alias("hit"))
    assert [r.hit for r in got] == [True, False]


def test_escapes(spark):
    values = ["a & b < c > \\ ` * _ [x] | #1", 'quo"te\'s', "line\nbreak  here"]
    got = rows(spark, values, text.markdown_text(F.col("t")).alias("md"), text.table_cell(F.col("t")).alias("cell"), text.html_escape(F.col("t")).alias("html"), text.digest_title(F.col("t")).alias("title"))
    assert got[0].md == "a &amp; b &lt; c &gt; \\\\ \\` \\* \\_ \\[x\\] \\| \\#1"
    assert got[0].cell.endswith("&#92; ` * _ [x] &#124; #1") and got[2].title == "line break here"
    assert [r.html for r in got] == [html.escape(v, quote=True) for v in values]


def test_scrub_and_forbidden_keys(spark):
    got = rows(spark, ["Bearer abc.DEF-1 and ?key=s3cret&x=1 my-secret-long my-secret"], text.scrub(F.col("t"), ["my-secret", "my-secret-long"]).alias("s"))
    assert got[0].s == "Bearer [REDACTED] and ?key=[REDACTED]&x=1 [REDACTED] [REDACTED]"
    kept = spark.range(1).select(text.drop_forbidden(F.expr("map('API_KEY','x','note','y','image_path','z')")).alias("m")).first().m
    assert kept == {"note": "y"}


def test_numbers(spark):
    got = rows(spark, ["Dice 0.85 vs 1,234 at 12 %, v2 and x3, ５ and 5", "none"], text.numbers(text.quote_form(F.col("t"))).alias("n"))
    assert got[0].n == ["0.85", "1234", "12%", "5"] and got[1].n == []


def test_identifiers(spark):
    cases = {"https://arxiv.org/abs/2610.00001v2": ("2610.00001", "2610.00001v2"), "http://export.arxiv.org/pdf/2610.0001.pdf": ("2610.0001", "2610.0001"),
             "hep-th/9901001v2": ("hep-th/9901001", "hep-th/9901001v2"), "2610.00001v0": (None, None), "2610.00001v2x": (None, None), "https://evil.org/abs/2610.00001": (None, None)}
    got = rows(spark, list(cases), ids.base_id(F.col("t")).alias("b"), ids.version_id(F.col("t")).alias("v"))
    assert [(r.b, r.v) for r in got] == list(cases.values())


def test_times_do_not_depend_on_the_session_zone(spark):
    values = ["2026-10-01T00:00:00Z", "2026-10-01T08:00:00+08:00", "2026-10-01T00:00:00", "2026-10-01", "bad"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = rows(spark, values, clock.parse_time(F.col("t")).cast("string").alias("p"), clock.moment(F.col("t"), end_of_day=True).cast("string").alias("m"),
                   clock.local_day(clock.parse_time(F.lit("2026-10-01T17:00:00Z"))).cast("string").alias("d"), clock.iso(clock.parse_time(F.col("t"))).alias("iso"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r.p for r in got] == ["2026-10-01 00:00:00"] * 2 + [None] * 3
    assert got[3].m == "2026-10-01 23:59:59.999999" and got[0].d == "2026-10-02" and got[0].iso == "2026-10-01T00:00:00+00:00"


def test_receipts(spark):
    cases = {None: "queued", "": "queued", "{}": "queued", '{"errcode":0}': "confirmed", '{"errcode":40001}': "failed", '{"errcode":true}': "unknown", '{"errcode":"0"}': "unknown",
             '{"errcode":0.0}': "unknown", "not json": "unknown", "[1]": "unknown", '"{\\"errcode\\":0}"': "confirmed"}
    got = rows(spark, list(cases), delivery.receipt_status(F.col("t")).alias("s"))
    assert [r.s for r in got] == list(cases.values())


def test_public_https(spark):
    cases = {"https://example.com/a": True, "HTTPS://example.com": True, "http://example.com": False, "https://u:p@example.com": False, "https:///x": False, "nope": False}
    assert [r.ok for r in rows(spark, list(cases), text.public_https(F.col("t")).alias("ok"))] == list(cases.values())
