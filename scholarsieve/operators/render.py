"""Digest text as ordered line tables, and byte-capped notifications.

A digest may hold very many items, so no operator builds one string per digest:
each item is one block row with sort keys, written out in order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholarsieve.functions import clock, ids, text
from scholarsieve.operators import ranking
from scholarsieve.session import cut_lineage, sized

# Default modules of items saved without a module list, and labels.
_FULL = ("title", "source", "llm_summary")
_LISTED = ("title", "title_translation", "abstract", "abstract_translation", "source")
_LIGHT = ("title", "source")
_TIERS = (("translation", "论文条目"), ("full", "完整档"), ("light", "轻量档"))
_FIELD_LABELS = (("background", "背景"), ("contribution", "贡献"), ("method", "方法"), ("experiments", "实验"), ("conclusion", "结论"))


def effective_modules() -> Column:
    listed = lambda names: F.array(*map(F.lit, names))
    fallback = F.when(F.col("tier") == "full", listed(_FULL)).when(F.col("tier") == "translation", listed(_LISTED)).otherwise(listed(_LIGHT))
    return F.coalesce("modules", fallback)


def trace_text(trace: str = "rule_trace") -> Column:
    """One line per met clause: route -> groups with their words and fields."""
    def words(hit):
        fields = F.transform(hit["fields"], lambda f: F.when(f == "title", "标题").otherwise("摘要"))
        return F.concat(text.markdown_text(hit["keyword"]), F.lit("（"), F.array_join(fields, "、"), F.lit("）"))

    def group(clause, name):
        return F.concat(text.markdown_text(name), F.lit("："), F.array_join(F.transform(clause["keywords"][name], words), " / "))

    def line(clause):
        groups = F.array_join(F.transform(clause["groups"], lambda g: group(clause, g)), " ＋ ")
        return F.concat(F.lit("- "), text.markdown_text(clause["route"]), F.lit(" → "), groups)

    lines = F.transform(F.coalesce(f"{trace}.clauses", F.array().cast("array<struct<route:string,groups:array<string>,keywords:map<string,array<struct<keyword:string,fields:array<string>>>>>>")), line)
    note = F.when(F.col(f"{trace}.source") == "reconstructed", F.array(F.lit("旧记录按当前规则补算，非历史命中证据。"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lines, note), "\n")


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"**{label}：** "), value)


def render_error() -> Column:
    """Why an item cannot be rendered, or null."""
    on = lambda name: F.array_contains("_modules", name)
    return (F.when(~F.col("tier").isin(*(t for t, _ in _TIERS)), "unknown_digest_tier")
            .when(on("title_translation") & text.blank(F.col("title_zh")), "translated_title_missing")
            .when(on("abstract_translation") & text.blank(F.col("abstract_zh")), "translated_abstract_missing")
            .when(F.col("summary").isNull() & (F.col("tier") != "light") & on("llm_summary"), "summary_missing")
            .when(F.col("summary").isNull() & (F.col("tier") != "light") & on("evidence"), "evidence_missing"))


def items(rows: DataFrame) -> DataFrame:
    """Add `block` (Markdown of one item) and `error` to digest items.

    Columns used: version_id, title, abstract, tier, title_zh, abstract_zh, summary,
    modules, rule_hits, rule_trace.
    """
    rows = rows.withColumn("_modules", effective_modules())
    on = lambda name, value: F.when(F.array_contains("_modules", name), value)
    paper = F.concat(F.lit("arXiv "), F.col("version_id"))
    title = F.concat(F.lit("### "), F.when(F.array_contains("_modules", "title"), text.digest_title(F.col("title"))).otherwise(paper))
    summary = F.when(F.col("summary").isNotNull(), F.concat_ws("\n\n", *(_labelled(label, F.col(f"summary.{name}")) for name, label in _FIELD_LABELS)))
    quoted = F.transform("summary.evidence", lambda e: F.concat(
        F.lit("- "), e["field"], F.lit(" · ["), e["locator"], F.lit("]("), e["source_url"], F.lit(")："), e["quote"]))
    evidence = F.when(F.col("summary").isNotNull(), F.concat(F.lit("**证据链：**\n"), F.array_join(quoted, "\n")))
    routes = F.array_join(F.array_distinct(F.coalesce("rule_hits", F.array().cast("array<string>"))), "、")
    details = trace_text()
    block = F.concat_ws(
        "\n\n", title, on("title_translation", _labelled("中文标题", F.col("title_zh"))), on("abstract", _labelled("摘要", F.col("abstract"))),
        on("abstract_translation", _labelled("摘要翻译", F.col("abstract_zh"))),
        on("llm_summary", F.coalesce(summary, F.lit("**LLM总结：** 轻量档未生成全文总结。"))),
        on("evidence", F.coalesce(evidence, F.lit("**证据链：** 轻量档未生成全文证据。"))),
        on("source", F.concat(F.lit("**来源：** ["), paper, F.lit("]("), ids.abstract_url(F.col("version_id")), F.lit(")"))),
        on("screening_routes", _labelled("初筛路径", F.when(routes == "", "无初筛命中记录").otherwise(routes))),
        on("screening_routes", F.when(details != "", F.concat(F.lit("**命中关键词：**\n"), details))))
    return rows.withColumn("block", block).withColumn("error", render_error()).drop("_modules")


def _recovered() -> Column:
    return F.coalesce("recovery_of", F.lit("")) != ""


def _tier_order() -> Column:
    return F.array_position(F.array(*(F.lit(t) for t, _ in _TIERS)), F.col("tier")).cast("int")


def _heading() -> Column:
    label = F.lit(None).cast("string")
    for tier, name in _TIERS:
        label = F.when(F.col("tier") == tier, name).otherwise(label)
    return F.concat(F.lit("## "), F.when(_recovered(), "补发").otherwise(""), label)


def archive_lines(rendered: DataFrame, digest: str = "digest_id") -> DataFrame:
    """Ordered blocks of every archive page: new items before recoveries, by tier, then position.

    Sort by (digest, recovery, tier_order, part, position) to read a page.
    """
    body = rendered.select(digest, _recovered().alias("recovery"), _tier_order().alias("tier_order"), F.lit(1).alias("part"),
                           F.col("position").cast("long").alias("position"), F.col("block").alias("line"))
    heads = rendered.select(digest, _recovered().alias("recovery"), _tier_order().alias("tier_order"), _heading().alias("line")).distinct()
    note = F.when(F.col("recovery"), F.concat(F.col("line"), F.lit("\n\n上一轮投递未确认，以下条目本次可能重复送达。"))).otherwise(F.col("line"))
    heads = heads.select(digest, "recovery", "tier_order", F.lit(0).alias("part"), F.lit(0).cast("long").alias("position"), note.alias("line"))
    return body.unionByName(heads)


def archive_page(rendered: DataFrame, day: Column, notes: list[str] = ()) -> DataFrame:
    """Lines of a digest's page with its title first and the run's notes last; sort as `archive_lines`, digests apart.

    Notes belong to the run and are few: they come as literals.
    """
    digest = rendered.select("digest_id").distinct()
    lines = archive_lines(rendered)
    shape = {c.name: c.dataType for c in lines.schema}
    extra = [F.struct(F.lit(False).alias("recovery"), F.lit(-1).alias("tier_order"), F.lit(0).alias("part"), F.lit(0).alias("position"),
                      F.concat(F.lit("# arXiv 每日简报 · "), day).alias("line"))]
    # Fixed value: the heading of the notes.
    texts = ["## 运行备注", *(f"- {n}" for n in notes)] if notes else []
    extra += [F.struct(F.lit(True).alias("recovery"), F.lit(99).alias("tier_order"), F.lit(2).alias("part"), F.lit(i).alias("position"), F.lit(t).alias("line"))
              for i, t in enumerate(texts)]
    around = digest.select("digest_id", F.inline(F.array(*extra)))
    return lines.unionByName(around.select(*(F.col(c).cast(t).alias(c) for c, t in shape.items())))


def duplicate_items(rendered: DataFrame, digest: str = "digest_id") -> DataFrame:
    """Papers listed more than once in a digest; must be empty."""
    return rendered.groupBy(digest, "base_id").count().where("count > 1")


def paper_index(records: DataFrame) -> DataFrame:
    """Rows of the long-term index, newest first: sort by (first_discovered, version_id) descending."""
    title_zh = F.coalesce(F.nullif("title_zh", F.lit("")), F.lit("待翻译"))
    cells = F.concat_ws(" | ", clock.local_day(F.col("first_discovered")).cast("string"), text.table_cell(F.col("title")), text.table_cell(title_zh),
                        F.concat(F.lit("[arXiv "), F.col("version_id"), F.lit("]("), ids.abstract_url(F.col("version_id")), F.lit(")")))
    lined = records.select("first_discovered", "version_id", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    return lined.orderBy(F.desc("first_discovered"), F.desc("version_id"))


# Title, note and table head of the index.
_INDEX_HEAD = ("# arXiv 论文长期索引", "日期为北京时间首次收集日期；按 arXiv ID 去重，包含规则命中的候选论文（不等同于已推送或已通过终筛）。",
               "| 日期 | 英文标题 | 中文标题 | 链接 |", "| --- | --- | --- | --- |")


def paper_index_page(records: DataFrame) -> DataFrame:
    """The index with its head: part counts the head's lines, rows come after them."""
    rows = paper_index(records).select(F.lit(len(_INDEX_HEAD)).alias("part"), "first_discovered", "version_id", "line")
    head = records.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, _INDEX_HEAD))).alias("part", "line"))
    return head.unionByName(rows, allowMissingColumns=True).select("part", "first_discovered", "version_id", "line")


def digest_items(records: DataFrame) -> DataFrame:
    """State record to digest item: only full items carry a summary, traces stay frozen."""
    return records.withColumns({
        "tier": F.col("intended_tier"),
        "summary": F.when(F.col("intended_tier") == "full", F.col("summary")),
        "rule_hits": F.coalesce("presentation_rule_hits", "rule_hits"),
        "rule_trace": F.coalesce("presentation_rule_trace", "rule_trace"),
    })


def _bytes(value: Column) -> Column:
    return F.octet_length(value)


def _omitted(count: Column) -> Column:
    """Bytes of the 'N light items only in the archive' line with its separator; 0 when none."""
    fixed = len("另有  篇轻量档仅列于公开存档。".encode("utf-8")) + 2
    return F.when(count > 0, F.length(count.cast("string")) + fixed).otherwise(0)


def notification(rendered: DataFrame, archive_url: Column, max_bytes: int, day: Column, digest: str = "digest_id",
                 index_url: str | None = None, feedback_url: str | None = None) -> DataFrame:
    """Fit every digest into `max_bytes`, exactly as evicting items one at a time would.

    Evictions follow a fixed order: translation, light, full, each from the end, then
    long link labels from the end. Every step changes the message by a known number of
    bytes, so the size after each step is a running total and the outcome of a digest is
    its first step that fits. Running totals are skew-proof, so a digest may be huge.

    Returns one row per item: mode, short_label, message_bytes (size of the digest's
    final message) and fits.
    """
    long_label = F.when(F.col("modules").isNotNull() & ~F.array_contains("modules", "title"), F.concat(F.lit("arXiv "), F.col("base_id"))) \
        .otherwise(text.digest_title(F.col("title")))
    link = lambda label: F.concat(F.lit("- ["), label, F.lit("]("), archive_url, F.lit(")：所选内容见公开存档。"))
    # Only ids and sizes from here on; stored once so that item text is rendered once.
    narrow = cut_lineage(rendered.select(digest, "base_id", "tier", _recovered().alias("recovery"), F.col("position").cast("long").alias("position"),
                             _bytes(F.col("block")).cast("long").alias("_block"), _bytes(link(long_label)).cast("long").alias("_link"),
                             _bytes(link(F.concat(F.lit("arXiv "), F.col("base_id")))).cast("long").alias("_short"),
                             _bytes(_heading()).cast("long").alias("_head"),
                             F.concat_ws("/", "recovery", "tier").alias("_section"), _bytes(archive_url).cast("long").alias("_url"),
                             _bytes(day.cast("string")).cast("long").alias("_day")))

    fixed = [("# arXiv 每日简报 · ", True)] + [("**补发：上一轮投递未确认，本次可能重复。**", False)]
    header = len(fixed[0][0].encode("utf-8"))
    recovery_note = len(fixed[1][0].encode("utf-8")) + 2
    footer = len("[完整日报与长期存档]()".encode("utf-8")) + 2
    extra = 1 + header + footer
    for label, url in (("[论文长期索引]({})", index_url), ("[反馈今日论文（逐篇勾选有用 / 无用）]({})", feedback_url)):
        extra += len(label.format(url).encode("utf-8")) + 2 if url else 0
    # Headings: at most six distinct (recovery, tier) sections per digest.
    sections = narrow.groupBy(digest, "_section").agg(
        F.max("_head").alias("_head"), F.sum(F.col("_block") + 2).alias("_blocks"), F.max("recovery").alias("_rec"),
        F.max("_url").alias("_url"), F.max("_day").alias("_day"))
    base = sections.groupBy(digest).agg((F.sum(F.col("_blocks") + F.col("_head") + 2) + F.max("_url") + F.max("_day") + extra
                                         + F.when(F.max("_rec"), recovery_note).otherwise(0)).alias("_base"))

    light = F.col("tier") == "light"
    phase = F.when(F.col("tier") == "translation", 0).when(light, 1).otherwise(2)
    evict = F.struct(phase.alias("phase"), F.when(light, -(F.col("_block") + 2)).otherwise(F.col("_link") - F.col("_block")).alias("delta"))
    shorten = F.struct(F.lit(3).alias("phase"), (F.col("_short") - F.col("_link")).alias("delta"))
    steps = narrow.select(digest, "base_id", "tier", "recovery", "position",
                          F.inline(F.when(light, F.array(evict)).otherwise(F.array(evict, shorten))))
    steps = steps.withColumn("_step", ranking.key("phase", (-F.col("position")).alias("back")))
    dropped = F.when(F.col("phase") == 1, 1).otherwise(0)
    run = ranking.running_totals(steps, [digest], "_step", {
        "_delta": F.col("delta"), "_new": F.when(~F.col("recovery"), dropped).otherwise(0).cast("long"),
        "_old": F.when(F.col("recovery"), dropped).otherwise(0).cast("long")}).join(sized(base), digest)
    measured = run.withColumn("_size", F.col("_base") + F.col("_delta") + _omitted(F.col("_new")) + _omitted(F.col("_old")))
    fits_here = F.col("_size") <= max_bytes
    outcome = measured.groupBy(digest).agg(
        F.first("_base").alias("_base"), F.min(F.when(fits_here, F.col("_step"))).alias("_stop"),
        F.min_by("_size", F.when(fits_here, F.col("_step"))).alias("_fit_size"), F.max_by("_size", "_step").alias("_last_size"))
    decided = measured.select(digest, "base_id", "tier", "phase", "_step").join(sized(outcome), digest)
    taken = (F.col("_base") > max_bytes) & (F.col("_stop").isNull() | (F.col("_step") <= F.col("_stop")))
    per_item = decided.groupBy(digest, "base_id", "tier").agg(
        F.bool_or(taken & (F.col("phase") < 3)).alias("_out"), F.bool_or(taken & (F.col("phase") == 3)).alias("short_label"),
        F.first(F.when(F.col("_base") <= max_bytes, F.col("_base")).otherwise(F.coalesce("_fit_size", "_last_size"))).alias("message_bytes"))
    tier = F.col("tier")
    mode = (F.when(~F.col("_out"), F.when(tier == "full", "rendered_inline_full").when(tier == "light", "light_title_link").otherwise("rendered_inline_translation"))
            .when(tier == "light", "light_archive_only").when(tier == "full", "archive_link_only").otherwise("translation_archive_link_only"))
    return per_item.select(digest, "base_id", "tier", mode.alias("mode"), "short_label", "message_bytes", (F.col("message_bytes") <= max_bytes).alias("fits"))


def notification_lines(rendered: DataFrame, fitted: DataFrame, archive_url: Column, digest: str = "digest_id") -> DataFrame:
    """Middle lines of fitted messages, ordered by (recovery, tier_order, part, position)."""
    rows = rendered.join(fitted.select(digest, "base_id", "mode", "short_label"), [digest, "base_id"])
    place = [digest, _recovered().alias("recovery"), _tier_order().alias("tier_order")]
    untitled = F.col("modules").isNotNull() & ~F.array_contains("modules", "title")
    label = F.when(F.col("short_label") | untitled, F.concat(F.lit("arXiv "), "base_id")).otherwise(text.digest_title(F.col("title")))
    link = F.concat(F.lit("- ["), label, F.lit("]("), archive_url, F.lit(")：所选内容见公开存档。"))
    inline = F.col("mode").isin("rendered_inline_full", "light_title_link", "rendered_inline_translation")
    left_out = F.col("mode") == "light_archive_only"
    body = rows.where(~left_out).select(*place, F.lit(1).alias("part"), F.col("position").cast("long").alias("position"),
                                        F.when(inline, F.col("block")).otherwise(link).alias("line"))
    heads = rows.select(*place, F.lit(0).alias("part"), F.lit(0).cast("long").alias("position"), _heading().alias("line")).distinct()
    omitted = rows.where(left_out).groupBy(*place).agg(F.count("*").alias("n")).select(
        digest, "recovery", "tier_order", F.lit(2).alias("part"), F.lit(0).cast("long").alias("position"),
        F.concat(F.lit("另有 "), F.col("n").cast("string"), F.lit(" 篇轻量档仅列于公开存档。")).alias("line"))
    return heads.unionByName(body).unionByName(omitted)
