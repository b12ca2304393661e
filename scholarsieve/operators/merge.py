"""Versions and cross-listings of one paper merged into one record."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholarsieve.functions import clock, ids
from scholarsieve.functions.text import blank, strip
from scholarsieve.operators import rules as screening
from scholarsieve.session import cut_lineage


def canonical(papers: DataFrame) -> DataFrame:
    """Trim and order-distinct the lists; derive the base id and the page address."""
    def tidy(name):
        return F.array_distinct(F.filter(F.transform(name, strip), lambda x: x != ""))

    return papers.withColumns({
        "authors": tidy("authors"), "categories": tidy("categories"), "version_id": ids.version_id(F.col("version_id")),
        "base_id": ids.base_id(F.col("version_id")),
    }).withColumn("url", ids.abstract_url(F.col("version_id")))


def from_feed(raw: DataFrame) -> DataFrame:
    """Feed record (entry_id, title, summary, categories, authors, times) to a paper row; `arrival` is null if it has none."""
    arrival = F.col("arrival") if "arrival" in raw.columns else F.lit(None)
    return canonical(raw.select(
        F.col("entry_id").alias("version_id"), strip(F.col("title")).alias("title"), strip(F.col("summary")).alias("abstract"),
        "categories", clock.parse_time(F.col("published")).alias("published"),
        clock.parse_time(F.col("updated")).alias("updated"), F.transform("authors", lambda a: a["name"]).alias("authors"),
        F.coalesce("pdf_url", F.lit("")).alias("pdf_url"), arrival.cast("long").alias("arrival")))


def invalid_reason(papers: DataFrame) -> Column:
    """Why a paper row is unusable, or null."""
    return (F.when(ids.base_id(F.col("version_id")).isNull(), "invalid_id")
            .when(F.col("published").isNull() | F.col("updated").isNull(), "time_not_zoned")
            .when(blank(F.col("title")) | blank(F.col("abstract")), "title_or_abstract_missing"))


def split_invalid(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with their `reason`): a paper without an id must never merge with another."""
    marked = papers.withColumn("reason", invalid_reason(papers))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def recency() -> Column:
    """Newest by update time, then numeric version; the first arrival wins a full tie."""
    return F.struct(F.col("updated"), ids.version_number(F.col("version_id")).alias("number"), (-F.col("arrival")).alias("first"))


def _tag(name: str) -> Column:
    return F.transform(name, lambda value, i: F.struct(F.lit(name).alias("list"), value.alias("value"), (-i).alias("place")))


def _listed(name: str) -> Column:
    return F.transform(F.filter("_all", lambda x: x["list"] == name), lambda x: x["value"])


def _unions(papers: DataFrame, lists) -> DataFrame:
    """Distinct values of each list per paper, newest version's order first.

    Values are reduced to one row per (paper, list, value) with map-side combining,
    so a paper with very many versions never gathers its raw rows in one task.
    """
    tagged = F.flatten(F.array(*map(_tag, lists)))
    values = papers.select("base_id", recency().alias("_recency"), F.inline(tagged))
    ranked = values.groupBy("base_id", "list", "value").agg(F.max(F.struct("_recency", "place")).alias("_rank"))
    listed = F.sort_array(F.collect_list(F.struct("_rank", "list", "value")), asc=False)
    return ranked.groupBy("base_id").agg(listed.alias("_all")).select("base_id", *(_listed(name).alias(name) for name in lists))


def merge_versions(papers: DataFrame, lists=("authors", "categories")) -> DataFrame:
    """One row per base id: newest content, all authors and categories ever seen.

    `arrival` orders the input. A missing pdf address falls back to the newest
    version that has one.
    """
    content = [c for c in papers.columns if c not in (*lists, "base_id")]
    newest = papers.groupBy("base_id").agg(
        F.max_by(F.struct(*content), recency()).alias("_n"),
        F.max_by("pdf_url", F.when(F.coalesce("pdf_url", F.lit("")) != "", recency())).alias("_pdf"))
    merged = newest.select("base_id", *(F.col(f"_n.{c}") for c in content if c != "pdf_url"),
                           F.coalesce(F.when(F.col("_n.pdf_url") != "", F.col("_n.pdf_url")), "_pdf", F.lit("")).alias("pdf_url"))
    united = merged.join(_unions(papers, lists), "base_id", "left")
    return united.withColumns({name: F.coalesce(name, F.array().cast("array<string>")) for name in lists})


_LAST = 2**62


def admit(matched: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Stop reading at the first new base id beyond the cap, in arrival order.

    Known ids do not use the cap. `limit` is a configured bound (at most 10000),
    so finding the cutoff keeps that many rows per task. Rows without an arrival come
    last and count as one.
    """
    arrival = F.coalesce("arrival", F.lit(_LAST))
    # Reduced to one row per paper before it meets the known ids.
    first = matched.groupBy("base_id").agg(F.min(arrival).alias("arrival"))
    news = first.join(known.select("base_id").distinct(), "base_id", "left_anti")
    over = news.orderBy("arrival").limit(limit + 1).agg(F.when(F.count("*") > limit, F.max("arrival")).alias("stop"))
    return matched.where(arrival < F.coalesce(over.scalar(), F.lit(_LAST + 1)))


def collect(scanned: DataFrame, rules: screening.RuleSet, known: DataFrame | None = None, limit: int | None = None,
            again=screening.match) -> DataFrame:
    """Screen each version, cap new ids, merge, then screen the merged record again
    (with `screening.trace` to also keep the evidence).

    The matches are stored once: the cap and the merge read them several times, and
    folding text is the costly part.
    """
    matched = cut_lineage(screening.match(scanned, rules).drop("routes"))
    kept = matched if limit is None else admit(matched, known, limit)
    return again(merge_versions(kept), rules)


def by_ids(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Point lookup in request order; unversioned requests take the latest update.

    `wanted` has `ordinal` and `requested`. Rows with a null version_id were not found.
    """
    asked = (wanted.select("ordinal", ids.version_id(F.col("requested")).alias("identifier"))
             .groupBy("identifier").agg(F.min("ordinal").alias("ordinal"))
             .withColumn("base_id", F.regexp_replace("identifier", r"v[0-9]+$", "")))
    pinned = asked.where(F.col("identifier") != F.col("base_id"))
    latest = asked.where(F.col("identifier") == F.col("base_id"))
    columns = [c for c in papers.columns if c != "base_id"]
    exact = pinned.join(papers.drop("base_id").withColumn("identifier", F.col("version_id")), "identifier", "left")
    needed = papers.join(latest.select("base_id"), "base_id", "left_semi")
    newest = needed.groupBy("base_id").agg(F.max_by(F.struct(*columns), F.struct("updated", "version_id")).alias("_n"))
    open_ = latest.join(newest, "base_id", "left").select(*latest.columns, "_n.*")
    return exact.select("ordinal", "identifier", *columns).unionByName(open_.select("ordinal", "identifier", *columns)).orderBy("ordinal")


def newest_first(papers: DataFrame) -> DataFrame:
    return papers.orderBy(F.desc("published"), F.desc("base_id"))


def upsert(state: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Full outer join of the paper state with newly collected papers.

    State rows: base_id, paper (struct), first_discovered, versions, latest_version,
    rule_hits, stage, decision_status, title_zh. Incoming: base_id, paper, routes.
    """
    s, i = state.alias("s"), incoming.alias("i")
    joined = s.join(i, F.col("s.base_id") == F.col("i.base_id"), "full_outer")
    is_new, seen = F.col("s.base_id").isNull(), F.col("i.base_id").isNotNull()
    version = F.col("i.paper.version_id")
    replace = seen & ~is_new & (F.col("s.stage") == "candidate") & F.col("s.decision_status").isNull()
    retitled = replace & ~F.col("s.paper.title").eqNullSafe(F.col("i.paper.title"))
    return joined.select(
        F.coalesce("s.base_id", "i.base_id").alias("base_id"),
        F.when(is_new | replace, F.col("i.paper")).otherwise(F.col("s.paper")).alias("paper"),
        F.coalesce("s.first_discovered", now).alias("first_discovered"),
        F.when(is_new, F.array(version)).when(seen, F.array_union("s.versions", F.array(version)))
        .otherwise(F.col("s.versions")).alias("versions"),
        F.when(seen & ~is_new, version).otherwise(F.col("s.latest_version")).alias("latest_version"),
        F.when(is_new, F.col("i.routes")).when(seen, F.array_sort(F.array_union("s.rule_hits", "i.routes")))
        .otherwise(F.col("s.rule_hits")).alias("rule_hits"),
        F.coalesce("s.stage", F.lit("candidate")).alias("stage"), F.col("s.decision_status").alias("decision_status"),
        F.when(~retitled, F.col("s.title_zh")).alias("title_zh"))
