"""Quote and number grounding, and text functions over whole documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from scholarsieve.functions import text
from scholarsieve.operators import fulltext, grounding
from scholarsieve.plans import stand_ins as s
from scholarsieve.plans.registry import query, table
from scholarsieve.schema import SUMMARY_FIELDS
from scholarsieve.sources.documents import trusted_host


@query(f"""
    WITH q AS (
        SELECT doc_id, text, CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'select' ELSE 'reject' END AS status,
               CASE doc_id % 5 WHEN 0 THEN [] WHEN 1 THEN [substr(text, 10, 60), substr(text, 3, 4)] WHEN 2 THEN [substr(text, 20, 80), upper(substr(text, 40, 30))]
                    WHEN 3 THEN [substr(text, 5, 25) || ' zzz'] ELSE [substr(text, greatest(length(text) - 50, 1), 40)] END AS quotes, doc_id % 2 AS doubts
        FROM documents JOIN labels USING (doc_id)),
    each AS (SELECT doc_id, text, unnest(quotes) AS quote FROM q),
    bad AS (SELECT doc_id, count(*) AS n, count(*) FILTER (length(trim(quote)) < 8 OR NOT contains({s.sql_quote_form('text')}, {s.sql_quote_form('quote')})) AS bad FROM each GROUP BY doc_id)
    SELECT q.doc_id, status, coalesce(n, 0) AS quotes, coalesce(bad, 0) AS bad,
           CASE WHEN status <> 'uncertain' AND coalesce(n, 0) = 0 THEN 'decision_evidence_missing' WHEN bad > 0 THEN 'decision_abstract_quote_unlocated'
                WHEN status = 'uncertain' AND doubts = 0 THEN 'decision_uncertainty_missing' END AS error
    FROM q LEFT JOIN bad USING (doc_id)""")
def abstract_quote_grounding(spark, d):
    t, n = F.col("text"), F.col("doc_id")
    quotes = (F.when(n % 5 == 0, F.array().cast("array<string>")).when(n % 5 == 1, F.array(F.substring(t, 10, 60), F.substring(t, 3, 4)))
              .when(n % 5 == 2, F.array(F.substring(t, 20, 80), F.upper(F.substring(t, 40, 30)))).when(n % 5 == 3, F.array(F.concat(F.substring(t, 5, 25), F.lit(" zzz"))))
              .otherwise(F.array(F.substring(t, F.greatest(F.length(t) - 50, F.lit(1)), F.lit(40)))))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    decisions = rows.select(n.alias("base_id"), t.alias("abstract"), F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "select").otherwise("reject").alias("status"),
                            quotes.alias("abstract_evidence"), F.when(n % 2 == 1, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("uncertainty"))
    return grounding.abstract_quotes(decisions).withColumnRenamed("base_id", "doc_id")


def _turns(spark, d):
    """Conversations as bodies: one version per conversation, the speaker names the section."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("version_id"), F.col("role").alias("locator"), F.col("turn").alias("pos"), "text")


@query(f"""
    WITH sources AS (SELECT conv_id, role, arg_min(text, turn) AS source FROM conversations GROUP BY ALL),
    evidence AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'appendix' ELSE role END AS role, substr(text, 5, 40) AS quote FROM conversations)
    SELECT e.conv_id, e.turn, CASE WHEN e.conv_id % 10 = 0 THEN 'evidence_source_mismatch'
           WHEN source IS NULL OR length(trim(quote)) < 12 OR NOT contains({s.sql_quote_form('source')}, {s.sql_quote_form('quote')}) THEN 'evidence_quote_unlocated' END AS error
    FROM evidence e LEFT JOIN sources s ON s.conv_id = e.conv_id AND s.role = e.role""")
def located_quote_grounding(spark, d):
    turns = _turns(spark, d)
    url = F.concat(F.lit("https://arxiv.org/html/"), F.col("version_id").cast("string"))
    evidence = turns.select("version_id", "pos", F.when(F.col("pos") % 5 == 4, "appendix").otherwise(F.col("locator")).alias("locator"), F.substring("text", 5, 40).alias("quote"),
                            F.when(F.col("version_id") % 10 == 0, "https://example.com").otherwise(url).alias("source_url"))
    urls = turns.select("version_id").distinct().withColumn("source_url", url)
    checked = grounding.locate(evidence, grounding.passages(turns), urls)
    return checked.select(F.col("version_id").alias("conv_id"), F.col("pos").alias("turn"), "error")


@query("""
    WITH x AS (
        SELECT l_orderkey, l_linenumber, l_partkey, 'Dice ' || CAST(l_quantity AS INTEGER) || ' over 1,0' || l_linenumber || ' scans, v2.x up ' || l_linenumber || ' %' AS claim,
               'measured ' || CAST(l_quantity AS INTEGER) || CASE WHEN l_partkey % 2 = 0 THEN ' on 10' || l_linenumber ELSE '' END
               || CASE WHEN l_partkey % 3 = 0 THEN ' gains ' || l_linenumber || '%' ELSE '' END AS proof FROM lineitem),
    n AS (SELECT *, list_transform(regexp_extract_all(replace(claim, 'v2.x', ''), '[0-9]+(?:[.,][0-9]+)*(?: *%)?'), lambda v: replace(replace(v, ' ', ''), ',', '')) AS c,
                 list_transform(regexp_extract_all(proof, '[0-9]+(?:[.,][0-9]+)*(?: *%)?'), lambda v: replace(replace(v, ' ', ''), ',', '')) AS p FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_distinct(list_filter(c, lambda v: NOT list_contains(p, v)))), ',') AS unverified FROM n""")
def numbers_except(spark, d):
    quantity, line = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    claim = F.concat(F.lit("Dice "), quantity, F.lit(" over 1,0"), line, F.lit(" scans, v2.x up "), line, F.lit(" %"))
    proof = F.concat(F.lit("measured "), quantity, F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(" on 10"), line)).otherwise(""),
                     F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" gains "), line, F.lit("%"))).otherwise(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                              F.array_join(F.array_sort(grounding.unverified_numbers(claim, proof)), ",").alias("unverified"))


@query("""
    WITH firsts AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'unqualified_fulltext' WHEN conv_id % 11 = 1 THEN 'summary_field_missing' WHEN conv_id % 11 = 2 THEN 'summary_evidence_schema'
           WHEN length(trim(substr(text, 1, 30))) < 12 THEN 'evidence_quote_unlocated'
           WHEN conv_id % 11 = 3 THEN 'evidence_quote_unlocated' WHEN conv_id % 11 = 4 THEN 'evidence_source_mismatch' WHEN conv_id % 11 = 5 THEN 'summary_conclusion_ungrounded'
           WHEN conv_id % 11 = 6 THEN 'summary_method_number_unverified' WHEN conv_id % 11 = 7 THEN 'summary_experiments_ungrounded' END AS error
    FROM firsts""")
def summary_validation(spark, d):
    turns = _turns(spark, d)
    first = turns.groupBy("version_id").agg(F.min_by("text", "pos").alias("text"), F.min_by("locator", "pos").alias("locator"))
    n = F.col("version_id") % 11
    url = F.concat(F.lit("https://arxiv.org/html/"), F.col("version_id").cast("string"))
    quote = F.substring("text", 1, 30)

    def cite(name):
        skip = F.lit(False)
        if name == "conclusion":
            skip = n == 5
        if name == "experiments":
            skip = n.isin(7, 8)
        kind = F.when((n == 2) & F.lit(name == "background"), "abstract").otherwise(name)
        body = F.when((n == 3) & F.lit(name == "contribution"), F.lit("words that are not there")).otherwise(quote)
        link = F.when((n == 4) & F.lit(name == "method"), "https://example.com").otherwise(url)
        return F.when(~skip, F.struct(kind.alias("field"), F.col("locator"), body.alias("quote"), link.alias("source_url"), F.lit("").alias("label")))

    values = {name: F.lit("as reported") for name in SUMMARY_FIELDS}
    values["background"] = F.when(n == 1, " ").otherwise("as reported")
    values["method"] = F.when(n == 6, "gains 98765 points").otherwise("as reported")
    values["experiments"] = F.when(n == 8, "未报告").otherwise("as reported")
    evidence = F.array_compact(F.array(*map(cite, SUMMARY_FIELDS)))
    summaries = first.select("version_id", F.struct(*(values[f].alias(f) for f in SUMMARY_FIELDS), evidence.alias("evidence")).alias("summary"))
    bodies = first.select("version_id", url.alias("source_url"), F.lit("html").alias("source_type"), (n != 0).alias("qualified"),
                          F.lit(None).cast("int").alias("physical_page_count"), F.lit(False).alias("method_on_first_page"), F.lit(False).alias("evaluation_on_first_page"))
    return grounding.summary_errors(summaries, bodies, grounding.passages(turns)).withColumnRenamed("version_id", "conv_id")


@query(f"""
    WITH notes AS (SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN 'remark' ELSE 'method' END AS kind, CASE WHEN doc_id % 6 = 1 THEN 'none' ELSE 'text' END AS locator,
                          CASE doc_id % 6 WHEN 2 THEN substr(text, 1, 9) WHEN 3 THEN substr(text, 1, 20) || ' qq' ELSE substr(text, 1, 450) END AS quote FROM documents)
    SELECT doc_id AS note_id, CASE WHEN kind = 'remark' THEN 'section_note_schema' WHEN locator = 'none' THEN 'section_note_locator'
           WHEN NOT (length(trim(quote, ' ')) BETWEEN 12 AND 400 AND contains({s.sql_quote_form('text')}, {s.sql_quote_form('quote')})) THEN 'section_note_outside_chunk' END AS error
    FROM notes""")
def note_grounding(spark, d):
    n, t = F.col("doc_id"), F.col("text")
    documents = table(spark, d, "documents")
    notes = documents.select(n.alias("note_id"), n.alias("chunk_key"), F.when(n % 6 == 1, "none").otherwise("text").alias("locator"),
                             F.when(n % 6 == 0, "remark").otherwise("method").alias("kind"),
                             F.when(n % 6 == 2, F.substring(t, 1, 9)).when(n % 6 == 3, F.concat(F.substring(t, 1, 20), F.lit(" qq"))).otherwise(F.substring(t, 1, 450)).alias("quote"))
    chunks = documents.select(n.alias("chunk_key"), F.lit("text").alias("locator"), t.alias("text"))
    return grounding.note_errors(notes, chunks).select("note_id", "error")


@query("""
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'review_evidence_missing' WHEN quality = 1 AND toxic = 0 AND doc_id % 4 <> 3 THEN 'review_theory_transfer_evidence_missing'
           WHEN quality = 1 AND toxic = 1 AND doc_id % 4 = 3 THEN 'review_method_evidence_missing' END AS error FROM labels""")
def review_evidence_fields(spark, d):
    n = F.col("doc_id") % 4
    fields = F.when(n == 0, F.array().cast("array<string>")).when(n == 3, F.array(F.lit("theory"), F.lit("transfer"))).otherwise(F.array(F.lit("method")))
    rows = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "select").otherwise("reject").alias("status"),
                                            F.when(F.col("toxic") == 1, "general_rl").otherwise("transferable_objective").alias("route"), fields.alias("fields"))
    return rows.select("doc_id", grounding.review_fields_error().alias("error"))


def _sql_escape(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
_BACKSLASH = tuple((c, "\\" + c) for c in "\\`*_[]|#")


@query(f"""
    SELECT doc_id, sha256({_sql_escape(s.sql_collapse('text'), (*_ENTITIES, *_BACKSLASH))}) AS markdown,
           sha256({_sql_escape(s.sql_collapse('text'), (*_ENTITIES, ('|', '&#124;'), (chr(92), '&#92;')))}) AS cell,
           sha256({_sql_escape(s.sql_collapse('text'), (('[', chr(92) + '['), (']', chr(92) + ']')))}) AS title,
           sha256({_sql_escape('text', (*_ENTITIES, ('"', '&quot;'), ("''", '&#x27;')))}) AS html, octet_length(encode(text)) AS bytes
    FROM documents""")
def text_escapes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(text.markdown_text(t), 256).alias("markdown"), F.sha2(text.table_cell(t), 256).alias("cell"),
                                               F.sha2(text.digest_title(t), 256).alias("title"), F.sha2(text.html_escape(t), 256).alias("html"), F.octet_length(t).alias("bytes"))


@query(r"""
    WITH x AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '&api_key=abc' || page_id || ' Bearer tok.' || page_id || '-z' WHEN 1 THEN '?KEY=s%3D' || page_id || '#top'
                      WHEN 2 THEN ' https://sctapi.ftqq.com/SCT' || page_id || '.send' ELSE ' hidden-canary-' || page_id END AS t FROM pages)
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(t, 'hidden-canary', '[REDACTED]'), '(?i)(bearer\s+)[\w.\-]+', '\1[REDACTED]', 'g'),
           '(?i)([?&](?:readkey|sendkey|api_key|token|key)=)[^\s&#)]+', '\1[REDACTED]', 'g'), 'https://sctapi\.ftqq\.com/[^/\s]+\.send', 'https://sctapi.ftqq.com/[REDACTED].send', 'g') AS clean
    FROM x""")
def secret_scrub(spark, d):
    n = F.col("page_id").cast("string")
    tail = (F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("&api_key=abc"), n, F.lit(" Bearer tok."), n, F.lit("-z"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("?KEY=s%3D"), n, F.lit("#top")))
            .when(F.col("page_id") % 4 == 2, F.concat(F.lit(" https://sctapi.ftqq.com/SCT"), n, F.lit(".send"))).otherwise(F.concat(F.lit(" hidden-canary-"), n)))
    return table(spark, d, "pages").select("page_id", text.scrub(F.concat("url", tail), ["hidden", "hidden-canary"]).alias("clean"))


@query("""
    SELECT page_id, '{"url":"' || url || '?token=[REDACTED]","runs":[{"n":' || page_id || ',"by":"Bearer [REDACTED]"}' || CASE WHEN page_id % 3 = 0 THEN ',{"n":1}' ELSE '' END || '],"notes":{'
           || CASE WHEN page_id % 2 = 0 THEN '"lang":{"n":2}' ELSE '' END || '}}' AS record FROM pages""")
def public_records(spark, d):
    """Pages as nested run records with credentials at every depth."""
    n = F.col("page_id")
    run = lambda i, by: F.struct(i.cast("long").alias("n"), F.lit("hidden").alias("Raw_Response"), by.alias("by"))
    runs = F.array(run(n, F.concat(F.lit("Bearer tok."), n.cast("string"))), F.when(n % 3 == 0, run(F.lit(1), F.lit(None).cast("string"))))
    note = F.struct(F.lit(2).alias("n"), F.lit("x").alias("sendkey"))
    notes = F.map_filter(F.create_map(F.lit("READKEY"), note, F.lit("lang"), note), lambda k, _: (n % 2 == 0) | (k == "READKEY"))
    record = F.struct(F.concat("url", F.lit("?token="), n.cast("string")).alias("url"), F.array_compact(runs).alias("runs"), notes.alias("notes"),
                      F.struct(F.lit("k").alias("api_key")).alias("account"))
    rows = table(spark, d, "pages").select("page_id", F.lit("secret").alias("Authorization"), record.alias("record"))
    return text.public_records(rows).select("page_id", F.to_json("record").alias("record"))


@query(r"""
    WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?', 'https') WHEN 1 THEN regexp_replace(url, '^https?://', 'https://user:pw@')
                      WHEN 2 THEN 'https://export.arxiv.org/abs/' || page_id ELSE 'ftp' || substr(url, 5) END AS url FROM pages)
    SELECT page_id, page_id % 4 IN (0, 2) AS public, page_id % 4 = 2 AS trusted FROM x""")
def url_checks(spark, d):
    n, url = F.col("page_id"), F.col("url")
    shaped = (F.when(n % 4 == 0, F.regexp_replace(url, "^https?", "https")).when(n % 4 == 1, F.regexp_replace(url, "^https?://", "https://user:pw@"))
              .when(n % 4 == 2, F.concat(F.lit("https://export.arxiv.org/abs/"), n.cast("string"))).otherwise(F.concat(F.lit("ftp"), F.expr("substr(url, 5)"))))
    return table(spark, d, "pages").select("page_id", text.public_https(shaped).alias("public"), trusted_host(shaped).alias("trusted"))


@query(r"""
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 'Figure ' || l_partkey || ': Overall framework' WHEN 2 THEN 'fig.' || l_partkey || 'a - results by split'
                      WHEN 3 THEN 'Table S' || l_partkey || ' Scores' WHEN 4 THEN 'as Figure ' || l_partkey || ' shows' WHEN 5 THEN 'Figure ' || l_partkey || ' shows'
                      WHEN 6 THEN l_partkey % 9 + 1 || '. Experimental Setup' ELSE 'Materials and Methods' END AS line FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE l_linenumber WHEN 1 THEN 'Figure ' || l_partkey WHEN 2 THEN 'fig.' || l_partkey || 'a' WHEN 3 THEN 'Table S' || l_partkey END AS label,
           CASE l_linenumber WHEN 1 THEN 'figure' || l_partkey WHEN 2 THEN 'figure' || l_partkey || 'a' WHEN 3 THEN 'tables' || l_partkey END AS key,
           CASE WHEN l_linenumber >= 6 THEN line END AS heading FROM x""")
def caption_and_heading(spark, d):
    n, line_no = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    line = (F.when(line_no == 1, F.concat(F.lit("Figure "), n, F.lit(": Overall framework"))).when(line_no == 2, F.concat(F.lit("fig."), n, F.lit("a - results by split")))
            .when(line_no == 3, F.concat(F.lit("Table S"), n, F.lit(" Scores"))).when(line_no == 4, F.concat(F.lit("as Figure "), n, F.lit(" shows")))
            .when(line_no == 5, F.concat(F.lit("Figure "), n, F.lit(" shows")))
            .when(line_no == 6, F.concat((F.col("l_partkey") % 9 + 1).cast("string"), F.lit(". Experimental Setup"))).otherwise("Materials and Methods"))
    label = fulltext.caption_label(line)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", label.alias("label"), fulltext.label_key(label).alias("key"), fulltext.pdf_heading(line).alias("heading"))


@query(f"""
    WITH {s.PAPERS}
    SELECT doc_id, list_has_any(categories, ['en', 'src3', 'src4']) AS overlap, array_to_string(list_sort(list_distinct(list_concat(categories, ['en', 'src3']))), ',') AS united,
           array_to_string(list_filter(categories, lambda x: list_contains(['en', 'src3'], x)), ',') AS shared, array_to_string(list_filter(categories, lambda x: NOT list_contains(['en', 'src3'], x)), ',') AS rest,
           list_contains(categories, 'en') AND list_contains(categories, 'src3') AS covers
    FROM papers""")
def category_set_operations(spark, d):
    wanted = F.array(F.lit("en"), F.lit("src3"))
    return s.papers(spark, d).select(
        "doc_id", F.arrays_overlap("categories", F.array(F.lit("en"), F.lit("src3"), F.lit("src4"))).alias("overlap"), F.array_join(F.array_sort(F.array_union("categories", wanted)), ",").alias("united"),
        F.array_join(F.array_intersect("categories", wanted), ",").alias("shared"), F.array_join(F.array_except("categories", wanted), ",").alias("rest"),
        F.forall(wanted, lambda w: F.array_contains("categories", w)).alias("covers"))
