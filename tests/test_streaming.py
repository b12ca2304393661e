"""Rolling collection: new versions merge, replays change nothing, late papers are kept aside."""
import json
from datetime import datetime, timedelta, timezone

from scholarsieve import config as settings
from scholarsieve.functions import clock
from scholarsieve.operators import merge
from scholarsieve.plans.daily import DailyRun
from scholarsieve.schema import PAPER
from scholarsieve.sources.sinks import Store
from scholarsieve.streaming import rolling
from pyspark.sql import functions as F

NOW = datetime(2026, 10, 20, tzinfo=timezone.utc)


def write(path, arrival, n, version, days_ago, text="medical segmentation with a loss"):
    at = (NOW - timedelta(days=days_ago)).isoformat()
    row = {"version_id": f"2610.{n:05d}v{version}", "title": "T", "abstract": text, "categories": ["cs.CV"], "published": at,
           "updated": (NOW - timedelta(days=days_ago) + timedelta(hours=version)).isoformat(), "authors": [f"A{version}"], "pdf_url": "", "arrival": arrival}
    (path / f"{arrival}.json").write_text(json.dumps(row))


def test_rolling_collection(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store = Store(spark, str(tmp_path / "state"))

    def drain():
        raw = spark.readStream.schema(PAPER + ", arrival long").json(str(source))
        rows = merge.canonical(raw.withColumns({c: clock.parse_time(F.col(c)) for c in ("published", "updated")}))
        query = rolling.screen_batches(rows, lambda: DailyRun(store, settings.builtin(), None, now=NOW), store, str(tmp_path / "ckpt"))
        query.awaitTermination()

    write(source, 0, 1, 1, 2)
    write(source, 1, 2, 1, 30)
    write(source, 2, 3, 1, 2, "nothing of interest")
    drain()
    write(source, 3, 1, 2, 2)
    drain()
    papers = {r.base_id: r for r in store.load("papers").collect()}
    assert list(papers) == ["2610.00001"] and papers["2610.00001"].versions == ["2610.00001v1", "2610.00001v2"]
    assert papers["2610.00001"].paper.version_id == "2610.00001v2" and papers["2610.00001"].rule_trace.version_id == "2610.00001v2"
    assert [r.base_id for r in spark.read.parquet(str(tmp_path / "state/late")).collect()] == ["2610.00002"]
