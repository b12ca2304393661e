"""One query per operator over its whole table, with production parameters, and SQL where it can say the same."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from scholarsieve.llm import (decontamination, divergence, embeddings, filter_audit, html_text, licenses, minhash, mixing, packing, repeats, secrets,
                              tokens, toxicity)
from scholarsieve.llm.common import bound_batches

QUERIES: dict = {}
CHECKS: dict = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_license_scan(spark, folder):
    """One row per document and license template that it contains."""
    return licenses.scan(table(spark, folder, "documents"))


@query
def op2_benchmark_decontamination(spark, folder):
    """One row per document and test item that it holds within the error budget."""
    return decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_source_mixing(spark, folder):
    taken = mixing.copies(table(spark, folder, "documents"))
    return taken.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
                        F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"))


CHECKS["op3_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
-- A level fits when exactly the sources whose cap lies below it are full.
levels AS (
  SELECT (1.5 * (SELECT sum(source_size) FROM sources) - coalesce((SELECT sum(2 * f.source_size) FROM sources f WHERE f.source_size / f.w < s.source_size / s.w), 0))
         / (SELECT sum(o.w) FROM sources o WHERE o.source_size / o.w >= s.source_size / s.w) AS level,
         s.source_size, s.w FROM sources s),
chosen AS (SELECT min_by(level, source_size / w) AS level FROM levels WHERE level * w <= 2 * source_size),
goals AS (
  SELECT source, source_size, CAST(least(2.0 * source_size, coalesce(level * w, 2.0 * source_size)) AS DOUBLE) AS target FROM sources, chosen),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) / 281474976710656.0 AS u
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


@query
def op4_html_extraction(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


@query
def op5_embedding_near_dedup(spark, folder):
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


CHECKS["op5_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) c ON c.vec_id = v.vec_id
"""


@query
def op6_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))


@query
def op7_token_files(spark, folder):
    files = tokens.write_files(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_digest(files)


@query
def op8_suffix_dedup(spark, folder):
    return repeats.repeats(table(spark, folder, "documents")).drop("spans")


@query
def op9_minhash_near_dedup(spark, folder):
    found = minhash.near_duplicates(table(spark, folder, "documents"), width=2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query
def op10_secret_scan(spark, folder):
    docs = table(spark, folder, "documents")
    return secrets.digest(secrets.scan(docs, secrets.learn(docs)))


@query
def op11_source_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))


CHECKS["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
occurrences AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
lang_sums AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
found AS (
  SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, l.total AS lang_total, coalesce(s.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN lang_sums l ON g.lang = l.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM found GROUP BY ALL) s ON g.lang = s.lang AND g.source = s.source),
prices AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(f.n, 0) + 5)) // CAST(g.total + 5 * g.v AS HUGEINT) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // CAST(g.lang_total + 5 * g.v AS HUGEINT) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM prices WHERE n > 0 AND p > q),
ranked AS (
  SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term' AS part, * FROM terms)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM ranked QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) <= 50
"""


@query
def op12_sequence_packing(spark, folder):
    return packing.digest(packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query
def op13_filter_audit(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


CHECKS["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, max(coalesce(CAST(quality = 1 AS INT), 0)) AS good, max(coalesce(CAST(toxic = 1 AS INT), 0)) AS toxic FROM labels GROUP BY doc_id),
worded AS (SELECT d.*, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(x.t, '[A-Z]')) > 2 * length(x.t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(x.t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN coalesce(x.doc_id > f.first, FALSE) THEN 'E' ELSE '' END AS fails
  FROM worded x JOIN firsts f ON x.t = f.t LEFT JOIN marks m ON m.doc_id = x.doc_id),
counted AS (SELECT part, good, toxic, fails, count(*) AS n FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || e.l || f.l AS filter_order FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
  JOIN letters e ON e.l NOT IN (a.l, b.l, c.l) JOIN letters f ON f.l NOT IN (a.l, b.l, c.l, e.l)),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS filter, substr(filter_order, 1, s - 1) AS earlier FROM orders, unnest([1, 2, 3, 4, 5]) u(s)),
judged AS (
  SELECT part, filter_order, step, filter, good, toxic, n, contains(fails, filter) AS fails_here, fails = filter AS fails_alone,
         length(translate(earlier, fails, '')) < length(earlier) AS gone
  FROM counted, steps),
audit AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN NOT gone AND NOT fails_here THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_here THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails_here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails_alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails_here THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_here THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM audit
"""
