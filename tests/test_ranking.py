"""Quotas, running totals and fitted messages against brute force, with one huge group."""
import random

import pytest
from pyspark.sql import functions as F

from scholarsieve import config as settings
from scholarsieve.operators import ledger, ranking, render

PRICES = settings.builtin()["llm"]["pricing"]


def queue(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", rng.randrange(50), f"p{i:04d}", rng.random() < 0.4) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, score int, id string, ok boolean")
    return rows, frame.repartition(7).withColumn("order", ranking.key((-F.col("score")).alias("s"), "id"))


def ordered(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (-r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_quota_and_first_k_successes(spark):
    rows, frame = queue(spark)
    top = {r.id for r in ranking.mark_quota(frame, ["g"], "order", 3).where("within").collect()}
    done = {r.id: r.within for r in ranking.mark_quota(frame, ["g"], "order", 3, counts=F.col("ok")).collect()}
    assert top == {r[2] for g in ordered(rows).values() for r in g[:3]}
    for group in ordered(rows).values():
        slots = 3
        for r in group:
            assert done[r[2]] is (slots > 0)
            slots -= r[3] and slots > 0
    assert ranking.mark_quota(frame, ["g"], "order", 0).where("within").count() == 0


def test_a_quota_keeps_few_rows_before_its_shuffle(spark):
    _, frame = queue(spark)
    plan = ranking.kth(frame, ["g"], "order", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_positions_and_totals_of_a_huge_group(spark):
    rows, frame = queue(spark, 2, 900)
    got = {r.id: (r.position, r.total) for r in ranking.running_totals(frame, ["g"], "order", {"position": F.lit(1).cast("long"), "total": F.col("score").cast("long")}, partitions=9).collect()}
    for group in ordered(rows).values():
        total = 0
        for i, r in enumerate(group, 1):
            total += r[1]
            assert got[r[2]] == (i, total)


def test_slots_already_taken_are_respected(spark):
    rows, frame = queue(spark, 3)
    taken = frame.where("id < 'p0030'")
    picks = {r.id for r in ranking.fill_slots(frame.where("id >= 'p0030'"), taken, ["g"], "order", 8).collect()}
    expected = set()
    for g, group in ordered(rows).items():
        free = 8 - sum(r[2] < "p0030" for r in group)
        expected |= {r[2] for r in [r for r in group if r[2] >= "p0030"][:max(free, 0)]}
    assert picks == expected


def test_cost_guard_replay(spark):
    rng = random.Random(4)
    rows = [("run", i, None if i == 700 else rng.randrange(1, 900) / 1e4) for i in range(800)] + [("other", i, 0.01) for i in range(20)]
    frame = spark.createDataFrame(rows, "run string, n int, cost double").withColumn("order", ranking.key("n"))
    got = {(r.run, r.n): r.guard for r in ledger.guard_calls(frame, ["run"], "order", 25.0).collect()}
    spent = 0
    for run, n, cost in rows[:800]:
        assert got[run, n] == ("usage_unknown" if n > 700 else "cost_cap" if round(spent, 8) >= 25 else "allowed")
        spent += cost or 0
    assert {got["other", i] for i in range(20)} == {"allowed"}


def test_usage_cost(spark):
    rows = [(1000000, 0, 1000000), (1000000, 2000000, 1), (None, 0, 5), (10, None, 10), (0, 0, 10), (-1, 0, 1)]
    frame = spark.createDataFrame(rows, "prompt_tokens long, cached_tokens long, completion_tokens long")
    assert [r.c for r in frame.select(ledger.usage_cost(PRICES).alias("c")).collect()] == [10.0, 0.040008, None, 0.0001, None, None]
    assert frame.select(ledger.usage_cost({**PRICES, "output_per_million": 0}).alias("c")).where("c IS NOT NULL").count() == 0


def simulate(items, cap, url):
    """Evict one item at a time, measuring the whole message each time."""
    inline, short = {i["id"] for i in items}, set()
    labels = {"translation": "论文条目", "full": "完整档", "light": "轻量档"}

    def compose():
        modes, lines = {}, ["# arXiv 每日简报 · 2026-10-01"]
        if any(i["old"] for i in items):
            lines.append("**补发：上一轮投递未确认，本次可能重复。**")
        for old in (False, True):
            for tier in ("translation", "full", "light"):
                group = [i for i in items if i["tier"] == tier and i["old"] == old]
                if not group:
                    continue
                lines.append("## " + ("补发" if old else "") + labels[tier])
                omitted = 0
                for i in group:
                    if i["id"] in inline:
                        lines.append(i["block"])
                        modes[i["id"]] = "in"
                    elif tier == "light":
                        omitted += 1
                        modes[i["id"]] = "light_archive_only"
                    else:
                        label = f"arXiv {i['id']}" if i["id"] in short else i["title"]
                        lines.append(f"- [{label}]({url})：所选内容见公开存档。")
                        modes[i["id"]] = "link"
                if omitted:
                    lines.append(f"另有 {omitted} 篇轻量档仅列于公开存档。")
        lines.append(f"[完整日报与长期存档]({url})")
        return "\n\n".join(lines) + "\n", modes

    body, modes = compose()
    for tier in ("translation", "light", "full"):
        for i in reversed(items):
            if len(body.encode()) <= cap:
                break
            if i["tier"] == tier:
                inline.discard(i["id"])
                body, modes = compose()
    for i in reversed(items):
        if len(body.encode()) <= cap:
            break
        if i["tier"] != "light":
            short.add(i["id"])
            body, modes = compose()
    return body, modes, short


@pytest.mark.parametrize("seed, cap", [(1, 30000), (2, 6000), (3, 4000), (4, 2500), (5, 900), (6, 5000)])
def test_messages_fit_exactly_like_evicting_one_by_one(spark, seed, cap):
    rng, url = random.Random(seed), "https://example.com/a"
    items = [{"id": f"2610.{n:05d}", "tier": rng.choice(["translation", "full", "light"]), "old": rng.random() < 0.3, "title": "题 " * rng.randrange(1, 30) + "t",
              "block": "文x" * rng.randrange(5, 120)} for n in range(40)]
    rows = [("d", n, i["id"], i["tier"], "p" if i["old"] else None, i["title"], i["block"], None) for n, i in enumerate(items)]
    frame = spark.createDataFrame(rows, "digest_id string, position int, base_id string, tier string, recovery_of string, title string, block string, modules array<string>")
    fitted = render.notification(frame, F.lit(url), cap, F.lit("2026-10-01"))
    body, modes, short = simulate(items, cap, url)
    got = {r.base_id: r for r in fitted.collect()}
    for key, mode in modes.items():
        assert got[key].mode == mode or (mode == "in" and (got[key].mode.startswith("rendered_inline") or got[key].mode == "light_title_link")) or (mode == "link" and got[key].mode.endswith("archive_link_only"))
        assert got[key].short_label == (key in short)
        assert got[key].message_bytes == len(body.encode()) and got[key].fits == (len(body.encode()) <= cap)
    lines = render.notification_lines(frame, fitted, F.lit(url)).orderBy("recovery", "tier_order", "part", "position").collect()
    text = "\n\n".join(["# arXiv 每日简报 · 2026-10-01", *(["**补发：上一轮投递未确认，本次可能重复。**"] if any(i["old"] for i in items) else []),
                        *(r.line for r in lines), f"[完整日报与长期存档]({url})"]) + "\n"
    assert text == body
