"""Collection, merge, window and identifier queries."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from scholarsieve.functions import clock, ids
from scholarsieve.operators import merge, rules
from scholarsieve.operators.rules import RuleSet
from scholarsieve.plans import stand_ins as s
from scholarsieve.plans.registry import query, table
from scholarsieve.streaming import gaps, rolling
from scholarsieve.plans.window import next_cursor, plan_windows
from scholarsieve.sources import scan

_START, _END = datetime(2024, 1, 3, 4, 5, 30), datetime(2024, 1, 17, 12, 0, 0)
_LISTS = "array_to_string({0}, ',') AS {0}"

# Rules over event papers: errors and purchases, by words of their abstract.
EVENT_RULES = RuleSet.of({"categories": [], "groups": {"FAULT": ["error"], "SALE": ["purchase"], "KEY": ["k"]},
                          "routes": {"fault": [["FAULT", "KEY"]], "sale": [["SALE", "KEY"]]}})


@query("""
    SELECT event_id, strftime(date_trunc('minute', ts), '%Y%m%d%H%M') AS minute FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-03 04:05:30' AND TIMESTAMP '2024-01-17 12:00:00'""")
def collection_window(spark, d):
    events = table(spark, d, "events").withColumnRenamed("ts", "published")
    return scan.window_scan(events, _START, _END).select("event_id", clock.query_stamp(clock.minute(F.col("published"))).alias("minute"))


@query("""
    WITH RECURSIVE per_minute AS (
        SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-03 04:05:30' AND TIMESTAMP '2024-01-17 12:00:00' GROUP BY 1),
    limits AS (SELECT CAST(sum(n) AS BIGINT) // 9 AS cap FROM per_minute),
    spans AS (
        SELECT TIMESTAMP '2024-01-03 04:05:00' AS lo, TIMESTAMP '2024-01-17 12:00:00' AS hi, 0 AS depth
        UNION ALL
        SELECT unnest([CASE WHEN date_diff('minute', lo, hi) = 1 THEN {'a': lo, 'b': lo}
                            ELSE {'a': lo, 'b': lo + (date_diff('minute', lo, hi) // 2) * INTERVAL 1 MINUTE} END,
                       CASE WHEN date_diff('minute', lo, hi) = 1 THEN {'a': hi, 'b': hi}
                            ELSE {'a': lo + (date_diff('minute', lo, hi) // 2) * INTERVAL 1 MINUTE, 'b': hi} END]).a,
               unnest([CASE WHEN date_diff('minute', lo, hi) = 1 THEN lo ELSE lo + (date_diff('minute', lo, hi) // 2) * INTERVAL 1 MINUTE END,
                       hi]),
               depth + 1
        FROM spans WHERE date_diff('minute', lo, hi) >= 1
             AND (SELECT sum(n) FROM per_minute WHERE m BETWEEN lo AND hi) >= (SELECT cap FROM limits)),
    counted AS (SELECT lo, hi, depth, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM per_minute WHERE m BETWEEN lo AND hi), 0) AS n, (SELECT cap FROM limits) AS cap FROM spans)
    SELECT strftime(lo, '%Y%m%d%H%M') AS "start", strftime(hi, '%Y%m%d%H%M') AS "end", depth, least(n, cap) AS seen,
           CASE WHEN n < cap THEN 'complete' WHEN lo < hi THEN 'split' ELSE 'shard_limit' END AS status, (SELECT bool_and(n < cap OR lo < hi) FROM counted) AS complete
    FROM counted""")
def shard_plan(spark, d):
    events = table(spark, d, "events").select(F.col("ts").alias("published"), F.array("event_type").alias("categories"))
    total = scan.window_scan(events, _START, _END).count()
    audit = scan.shard_audit(events, _START, _END, (), shard_limit=total // 9)
    return audit.select(clock.query_stamp("start").alias("start"), clock.query_stamp("end").alias("end"), "depth", "seen", "status", "complete")


@query("""
    SELECT CAST((ts + INTERVAL 8 HOUR)::DATE AS VARCHAR) AS day, count(*) AS papers FROM events GROUP BY 1""")
def local_day_counts(spark, d):
    day = clock.local_day(F.col("ts")).cast("string")
    return table(spark, d, "events").groupBy(day.alias("day")).agg(F.count("*").alias("papers"))


@query("""
    WITH raw AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS base, ts, event_id % 5 AS kind FROM events)
    SELECT event_id,
           CASE kind WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') WHEN 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f')
                     WHEN 2 THEN strftime(date_trunc('second', ts) - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S.%f') END AS utc,
           CASE WHEN kind = 3 THEN strftime(ts::DATE::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND, '%Y-%m-%d %H:%M:%S.%f')
                WHEN kind = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') WHEN kind = 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f')
                WHEN kind = 2 THEN strftime(date_trunc('second', ts) - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S.%f') END AS window_end
    FROM raw""")
def parse_times(spark, d):
    t = F.col("ts")
    text = (F.when(F.col("event_id") % 5 == 0, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
            .when(F.col("event_id") % 5 == 1, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
            .when(F.col("event_id") % 5 == 2, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
            .when(F.col("event_id") % 5 == 3, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")))
    return table(spark, d, "events").select("event_id", s.stamp(clock.parse_time(text)).alias("utc"),
                                            s.stamp(clock.moment(text, end_of_day=True)).alias("window_end"))


_NEWEST = """newest AS (
    SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY updated DESC, number DESC, arrival) AS rank FROM {0}),
    ordered AS (SELECT base_id, rank, unnest({1}) AS value, generate_subscripts({1}, 1) AS pos FROM newest),
    firsts AS (SELECT base_id, value, min(rank * 1000 + pos) AS first_seen FROM ordered GROUP BY ALL),
    merged AS (SELECT base_id, string_agg(value, ',' ORDER BY first_seen) AS {1} FROM firsts GROUP BY base_id)"""


@query(f"""
    WITH {s.VERSIONS}, {_NEWEST.format('versions', 'authors')},
    pdf AS (SELECT base_id, arg_min(pdf_url, rank) AS pdf FROM newest WHERE pdf_url <> '' GROUP BY base_id)
    SELECT n.base_id, n.version_id, n.title, strftime(n.updated, '{s.SQL_STAMP}') AS updated, m.authors,
           CASE WHEN n.pdf_url <> '' THEN n.pdf_url ELSE coalesce(pdf.pdf, '') END AS pdf_url
    FROM newest n JOIN merged m USING (base_id) LEFT JOIN pdf USING (base_id) WHERE n.rank = 1""")
def merge_newest_version(spark, d):
    merged = merge.merge_versions(s.versions(spark, d), lists=("authors",))
    return merged.select("base_id", "version_id", "title", s.stamp("updated").alias("updated"), F.array_join("authors", ",").alias("authors"), "pdf_url")


@query(f"""
    WITH {s.VERSIONS}, {_NEWEST.format('versions', 'categories')} SELECT base_id, categories FROM merged""")
def merge_category_union(spark, d):
    merged = merge.merge_versions(s.versions(spark, d), lists=("categories",))
    return merged.select("base_id", F.array_join("categories", ",").alias("categories"))


@query(f"""
    WITH {s.VERSIONS}, kept AS (SELECT * FROM versions WHERE event_type IN ('error', 'purchase')), {_NEWEST.format('kept', 'categories')}
    SELECT n.base_id, n.version_id, m.categories, CASE WHEN n.event_type = 'error' THEN 'fault' ELSE 'sale' END AS routes
    FROM newest n JOIN merged m USING (base_id) WHERE rank = 1""")
def filter_then_merge(spark, d):
    return merge.collect(s.versions(spark, d), EVENT_RULES).select("base_id", "version_id", F.array_join("categories", ",").alias("categories"), F.array_join("routes", ",").alias("routes"))


@query(f"""
    WITH {s.VERSIONS} SELECT arrival, list_aggregate(list_distinct(list_transform(authors, lambda a: trim(a))), 'string_agg', ',') IS NOT NULL AS has_authors,
           array_to_string(authors, ',') AS authors FROM versions""")
def canonical_metadata(spark, d):
    tidy = merge.canonical(s.versions(spark, d).withColumn("authors", F.flatten(F.array("authors", "authors"))))
    return tidy.select("arrival", (F.size("authors") > 0).alias("has_authors"), F.array_join("authors", ",").alias("authors"))


_CAP = 40


@query(f"""
    WITH known AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
    news AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders ANTI JOIN known ON c_custkey = o_custkey GROUP BY o_custkey),
    stop AS (SELECT CASE WHEN count(*) > {_CAP} THEN max(first) END AS stop_at FROM (SELECT first FROM news ORDER BY first LIMIT {_CAP + 1}))
    SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM known) AS known
    FROM orders WHERE o_orderkey < coalesce((SELECT stop_at FROM stop), 9223372036854775807)""")
def candidate_cap_known(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("base_id"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("base_id"), F.col("o_orderkey").alias("arrival"))
    kept = merge.admit(orders, known, _CAP).join(known.withColumn("known", F.lit(True)), "base_id", "left")
    return kept.select(F.col("arrival").alias("o_orderkey"), F.col("base_id").alias("o_custkey"), F.coalesce("known", F.lit(False)).alias("known"))


@query(f"""
    WITH {s.VERSIONS},
    asked AS (SELECT user_id, min(event_id) AS ordinal FROM events WHERE event_type = 'signup' GROUP BY user_id),
    wanted AS (SELECT ordinal, {s.sql_key('user_id')} || CASE WHEN user_id % 3 = 0 THEN 'v' || (user_id % 29 + 1) ELSE '' END AS requested FROM asked),
    hits AS (SELECT w.ordinal, w.requested, v.version_id,
                    row_number() OVER (PARTITION BY w.ordinal ORDER BY v.updated DESC, v.version_id DESC) AS rank
             FROM wanted w LEFT JOIN versions v ON v.version_id = w.requested OR v.base_id = w.requested)
    SELECT ordinal, requested AS identifier, version_id FROM hits WHERE rank = 1""")
def papers_by_ids(spark, d):
    events = table(spark, d, "events")
    asked = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("ordinal"))
    version = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("v"), (F.col("user_id") % 29 + 1).cast("string"))).otherwise("")
    wanted = asked.select("ordinal", F.concat(F.lit("https://arxiv.org/abs/"), s.paper_key("user_id"), version).alias("requested"))
    papers = s.versions(spark, d).select("base_id", "version_id", "updated").distinct()
    return merge.by_ids(papers, wanted).select("ordinal", "identifier", "version_id").distinct()


@query(f"""
    WITH {s.PAPERS}, {s.sql_matched(s.CORPUS_RULES)}
    SELECT {s.sql_key('coalesce(l.doc_id, p.doc_id)')} AS base_id,
           CASE WHEN l.doc_id IS NULL OR (l.toxic = 0 AND l.quality = 1 AND p.doc_id IS NOT NULL) THEN p.version_id ELSE {s.sql_key('l.doc_id')} || 'v1' END AS version_id,
           CASE WHEN l.doc_id IS NULL THEN p.version_id
                WHEN p.doc_id IS NULL OR p.version_id = {s.sql_key('l.doc_id')} || 'v1' THEN {s.sql_key('l.doc_id')} || 'v1'
                ELSE {s.sql_key('l.doc_id')} || 'v1,' || p.version_id END AS versions,
           CASE WHEN l.doc_id IS NULL THEN array_to_string(p.routes, ',') WHEN p.doc_id IS NULL THEN 'old'
                ELSE array_to_string(list_sort(list_append(p.routes, 'old')), ',') END AS rule_hits,
           CASE WHEN l.doc_id IS NULL OR l.toxic = 0 THEN 'candidate' ELSE 'selected' END AS stage,
           CASE WHEN l.doc_id IS NOT NULL AND NOT (l.toxic = 0 AND l.quality = 1 AND p.doc_id IS NOT NULL) THEN '题' END AS title_zh
    FROM labels l FULL JOIN matched p ON p.doc_id = l.doc_id""")
def upsert_state(spark, d):
    """Labels are the stored state, the screened corpus is what the run found."""
    paper = lambda version, title: F.struct(version.alias("version_id"), title.alias("title"))
    stored = F.concat(s.paper_key("doc_id"), F.lit("v1"))
    state = table(spark, d, "labels").select(
        s.paper_key("doc_id").alias("base_id"), paper(stored, F.lit("stored title")).alias("paper"),
        s.ntz("2024-01-01 00:00:00").alias("first_discovered"), F.array(stored).alias("versions"),
        F.lit(None).cast("string").alias("latest_version"), F.array(F.lit("old")).alias("rule_hits"),
        F.when(F.col("toxic") == 0, "candidate").otherwise("selected").alias("stage"),
        F.when(F.col("quality") == 0, "select").alias("decision_status"), F.lit("题").alias("title_zh"))
    incoming = rules.match(s.papers(spark, d), s.CORPUS_RULES).select("base_id", paper(F.col("version_id"), F.col("title")).alias("paper"), "routes")
    rows = merge.upsert(state, incoming, s.ntz("2024-02-01 00:00:00"))
    return rows.select("base_id", "paper.version_id", F.array_join("versions", ",").alias("versions"),
                       F.array_join("rule_hits", ",").alias("rule_hits"), "stage", "title_zh")


_WINDOW_STATES = """states AS (
        SELECT user_id, CASE WHEN user_id % 5 > 0 THEN min(ts) END AS initial_floor, CASE WHEN user_id % 3 > 0 THEN arg_min(ts, (value, event_id)) END AS last_complete
        FROM events GROUP BY user_id),
    planned AS (SELECT *, coalesce(initial_floor, TIMESTAMP '2024-01-22' - INTERVAL 7 DAY) AS floor FROM states),
    windows AS (SELECT *, greatest(floor, TIMESTAMP '2024-01-22' - INTERVAL 14 DAY) AS start FROM planned)"""


@query(f"""
    WITH {_WINDOW_STATES}
    SELECT user_id, strftime(start, '{s.SQL_STAMP}') AS start,
           strftime(CASE WHEN last_complete < start THEN greatest(last_complete, floor) WHEN last_complete IS NULL AND floor < start THEN floor END, '{s.SQL_STAMP}') AS gap_start,
           CASE WHEN last_complete < start THEN 'beyond_auto_lookback' WHEN last_complete IS NULL AND floor < start THEN 'initial_window_exceeded' END AS gap_reason,
           strftime(CASE WHEN user_id % 2 = 0 AND user_id % 7 > 0 THEN TIMESTAMP '2024-01-22' ELSE last_complete END, '{s.SQL_STAMP}') AS cursor
    FROM windows""")
def plan_window_gaps(spark, d):
    states = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("lo"), F.min_by("ts", F.struct("value", "event_id")).alias("at")).select(
        "user_id", F.when(F.col("user_id") % 5 > 0, F.col("lo")).alias("initial_floor"), F.when(F.col("user_id") % 3 > 0, F.col("at")).alias("last_complete"))
    planned = plan_windows(states, s.ntz("2024-01-22 00:00:00"))
    moved = next_cursor(planned, F.col("user_id") % 2 == 0, F.col("user_id") % 7 == 0)
    return moved.select("user_id", s.stamp("start").alias("start"), s.stamp("gap_start").alias("gap_start"), "gap_reason", s.stamp("last_complete").alias("cursor"))


@query(r"""
    WITH raw AS (
        SELECT doc_id, CASE doc_id % 7
            WHEN 0 THEN 'https://arxiv.org/abs/2610.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || 'v' || (doc_id % 4 + 1)
            WHEN 1 THEN 'http://export.arxiv.org/pdf/2610.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || '.pdf'
            WHEN 2 THEN ' hep-th/' || lpad(CAST(doc_id % 10000000 AS VARCHAR), 7, '0') || 'v12 '
            WHEN 3 THEN '2610.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || 'v0'
            WHEN 4 THEN 'https://example.com/abs/2610.00001'
            WHEN 5 THEN '2610.' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')
            ELSE substr(text, 1, 20) END AS id FROM documents),
    bare AS (SELECT doc_id, regexp_replace(regexp_replace(trim(id), '^https?://(export\.)?arxiv\.org/(abs|pdf|html)/', ''), '\.pdf$', '') AS id FROM raw),
    ok AS (SELECT doc_id, CASE WHEN regexp_full_match(id, '([0-9]{4}\.[0-9]{4,5}|[a-zA-Z][a-zA-Z.\-]*/[0-9]{7})(v[1-9][0-9]*)?') THEN id END AS id FROM bare)
    SELECT doc_id, id AS version_id, regexp_replace(id, 'v[0-9]+$', '') AS base_id,
           coalesce(TRY_CAST(nullif(regexp_extract(id, 'v([1-9][0-9]*)$', 1), '') AS INTEGER), 0) AS number FROM ok""")
def normalize_ids(spark, d):
    n = F.col("doc_id")
    five = F.lpad((n % 100000).cast("string"), 5, "0")
    raw = (F.when(n % 7 == 0, F.concat(F.lit("https://arxiv.org/abs/2610."), five, F.lit("v"), (n % 4 + 1).cast("string")))
           .when(n % 7 == 1, F.concat(F.lit("http://export.arxiv.org/pdf/2610."), five, F.lit(".pdf")))
           .when(n % 7 == 2, F.concat(F.lit(" hep-th/"), F.lpad((n % 10000000).cast("string"), 7, "0"), F.lit("v12 ")))
           .when(n % 7 == 3, F.concat(F.lit("2610."), five, F.lit("v0"))).when(n % 7 == 4, "https://example.com/abs/2610.00001")
           .when(n % 7 == 5, F.concat(F.lit("2610."), F.lpad((n % 10000).cast("string"), 4, "0"))).otherwise(F.substring("text", 1, 20)))
    return table(spark, d, "documents").select("doc_id", ids.version_id(raw).alias("version_id"), ids.base_id(raw).alias("base_id"),
                                               ids.version_number(ids.version_id(raw)).alias("number"))


@query(r"""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'model.v-' || page_id ELSE '' END AS token, page_id % 3 <> 1 AND page_id % 3 <> 2 AS digest_ok, page_id % 3 = 1 AS push_ok
    FROM pages""")
def identifier_safety(spark, d):
    n = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("model.v-"), n)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("a b/"), n)).otherwise(F.col("url"))
    digest = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("20261001T000000Z-"), n)).otherwise(F.concat(F.lit("../"), n))
    push = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("push_id-"), n)).otherwise(F.concat(F.lit("push id "), n))
    return table(spark, d, "pages").select("page_id", ids.safe_token(raw).alias("token"), ids.valid_digest_id(digest).alias("digest_ok"), ids.valid_push_id(push).alias("push_ok"))


@query("""
    SELECT event_id, CASE WHEN event_id % 11 <> 0 AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 14 DAY THEN 'on_time' ELSE 'late' END AS side FROM events""")
def late_rows(spark, d):
    """Events as arriving papers, some without a time: none is lost between the two sides."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("published"))
    on_time, late = rolling.split_late(rows, s.ntz("2024-01-20 00:00:00"), 14)
    return on_time.select("event_id", F.lit("on_time").alias("side")).unionByName(late.select("event_id", F.lit("late").alias("side")))


@query("""
    WITH arrived AS (SELECT event_id % 40 AS batch, epoch_us(CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 9 DAY ELSE ts END) // 1000 AS ms FROM events),
    newest AS (SELECT batch, max(ms) AS ms FROM arrived GROUP BY batch),
    marks AS (SELECT batch, max(ms) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5 * 86400000 AS mark FROM newest)
    SELECT (ms // 21600000 + 1) * 21600000 AS window_end, count(*) AS "rows", min(ms) AS first_ms, max(ms) AS last_ms
    FROM arrived JOIN marks USING (batch) WHERE (ms // 21600000 + 1) * 21600000 <= mark GROUP BY 1""")
def gap_report(spark, d):
    """Events as arrivals in forty batches, every third one nine days old: late ones are gaps of their windows."""
    at = F.when(F.col("event_id") % 3 == 0, F.col("ts") - F.expr("interval 9 days")).otherwise(F.col("ts"))
    rows = table(spark, d, "events").select((F.col("event_id") % 40).alias("batch"), at.alias("at"))
    return gaps.replay(rows, "at", "batch", hours=6, lookback_days=5)


@query("""
    SELECT CAST(coalesce(reason, 'usable') AS VARCHAR) AS reason, count(*) AS papers FROM (
        SELECT CASE WHEN event_id % 13 = 0 THEN 'invalid_id' WHEN event_id % 17 = 0 THEN 'time_not_zoned' WHEN event_id % 19 = 0 THEN 'title_or_abstract_missing' END AS reason FROM events) GROUP BY 1""")
def collection_rejects(spark, d):
    """Paper versions with broken ids, times and titles: rejected before anything is merged."""
    n = F.col("arrival")
    rows = s.versions(spark, d).withColumns({
        "version_id": F.when(n % 13 == 0, F.concat(F.lit("no id "), n.cast("string"))).otherwise(F.col("version_id")),
        "updated": F.when(n % 17 != 0, F.col("updated")), "title": F.when(n % 19 == 0, F.lit(" \t")).otherwise(F.col("title"))})
    usable, rejected = merge.split_invalid(rows)
    both = usable.select(F.lit("usable").alias("reason")).unionByName(rejected.select("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("papers"))
