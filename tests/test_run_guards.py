"""Guards, notices, the error log and public records."""
from datetime import timedelta

from pyspark.sql import functions as F

from scholarsieve import schema
from scholarsieve.functions import text
from scholarsieve.plans.daily import MockDelivery
from scholarsieve.sources.sinks import Store
from test_daily import NOW, fixture, start


def test_claims_are_exclusive(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    assert [one.claim("d-alert"), two.claim("d-alert"), two.claim("d-empty"), one.claim("d-empty")] == [True, False, True, False]


def test_repeated_appends_add_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *keys: spark.createDataFrame([(k, "x") for k in keys], "k string, v string")
    for keys in (("a", "b"), ("a", "b"), ("b", "c", "c")):
        store.append_once("log", rows(*keys), "k string, v string", "k")
    assert sorted(r.k for r in store.log("log", "k string, v string").collect()) == ["a", "b", "c"]


def test_empty_and_alert_notices_go_out_once_a_day(spark, tmp_path):
    delivery, source = MockDelivery(), fixture(tmp_path)
    run, papers = start(spark, tmp_path, source, delivery)
    assert run.run(papers)["delivery_kind"] == "digest"
    kinds = []
    for hour in (1, 2):
        again, papers = start(spark, tmp_path, source, delivery, NOW + timedelta(hours=hour))
        kinds.append(again.run(papers)["delivery_kind"])
    assert kinds == ["empty", "none"] and len(delivery.sent) == 2 and "没有新增" in delivery.sent[1][1]
    for hour in (3, 4):
        again, papers = start(spark, tmp_path, source, delivery, NOW + timedelta(hours=hour))
        kinds.append(again.run(papers, coverage_complete=False)["delivery_kind"])
    assert kinds[2:] == ["alert", "none"] and "collection_incomplete" in delivery.sent[2][1] and len(delivery.sent) == 3
    log = again.store.log("digests", schema.DIGEST_LOG)
    assert {r.kind for r in log.collect()} == {"normal", "empty", "alert"}


class Priced:
    """Answers of a fixture, each with its usage."""

    def __init__(self, inner, tokens):
        self.inner, self.tokens = inner, tokens

    def __getattr__(self, name):
        def call(*args):
            usage = F.struct(F.lit(self.tokens).alias("prompt_tokens"), F.lit(10).alias("completion_tokens"), F.lit(0).alias("cached_tokens"))
            return getattr(self.inner, name)(*args).withColumn("usage", usage)

        return call


def test_cost_guard_stops_calls_also_after_a_restart(spark, tmp_path):
    run, papers = start(spark, tmp_path, fixture(tmp_path))
    run.analysis = Priced(run.analysis, 1_000_000)
    run.config["llm"]["max_run_cost"] = 1.0
    run.collect(papers)
    run.select()
    spent = run.store.log("usage", schema.USAGE_LOG)
    assert spent.count() == 4 and spent.agg(F.sum("cost")).first()[0] > 1
    run.list_metadata()
    run.translate()
    assert run.errors == ["translation:run_cost_guard"] and "translation" not in run.calls
    again, _ = start(spark, tmp_path, fixture(tmp_path))
    again.run_id, again.config["llm"]["max_run_cost"] = run.run_id, 1.0
    assert again._guard() == "run_cost_guard"
    unknown, _ = start(spark, tmp_path, fixture(tmp_path))
    unknown.config["llm"]["max_run_cost"] = 1.0
    unknown.store.append("usage", spent.limit(1).withColumns({"run_id": F.lit(unknown.run_id), "cost": F.lit(None).cast("double")}))
    assert unknown._guard() == "run_cost_guard_usage_unknown"
    unknown.clock = lambda: unknown.started + 10**6
    assert unknown._guard() == "run_time_guard"


def test_failed_translations_are_logged_once(spark, tmp_path):
    run, papers = start(spark, tmp_path, fixture(tmp_path))
    translate = run.analysis.translate
    run.analysis.translate = lambda rows: translate(rows).where("base_id <> '2610.00001'")
    run.collect(papers)
    run.select()
    run.list_metadata()
    for _ in range(2):
        run.translate()
        run._log_translation_errors("translation", run._papers())
    log = [(r.run_id, r.stage, r.base_id, r.error) for r in run.store.log("translation_errors", schema.TRANSLATION_ERROR_LOG).collect()]
    assert log == [(run.run_id, "translation", "2610.00001", "translation_missing")]


def test_public_records_lose_keys_at_any_depth(spark):
    row = spark.createDataFrame([({"Api_Key": {"a": "x"}, "ok": {"token": "t"}}, [([("v", "raw", None)], "s")], ("k",), "Bearer abc", 7), (None, None, None, None, None)],
                                "m map<string,map<string,string>>, a array<struct<inner:array<struct<v:string,raw_response:string,image_path:string>>,SENDKEY:string>>, "
                                "gone struct<authorization:string>, s string, readKey int")
    first, second = text.public_records(row).collect()
    assert first.asDict(recursive=True) == {"m": {"ok": {"token": "t"}}, "a": [{"inner": [{"v": "v"}]}], "s": "Bearer [REDACTED]"}
    assert second.asDict() == {"m": None, "a": None, "s": None}
