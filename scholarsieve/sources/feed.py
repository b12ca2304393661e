"""Live metadata feed as a Spark data source whose partitions are time shards.

Rows are feed records for `merge.from_feed`. The feed allows one slow request at a
time, so the plan is built for politeness: a shard is one partition, and `lanes`
(default 1) bounds how many run at once.

Every row carries `arrival`: its shard's start minute and its place in the shard, which
are the same whenever the window is read again. As a stream, offsets are minutes; each
batch is the window since the last one, so a batch replayed after a failure asks for
the same window.
"""
from __future__ import annotations

import time
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ElementTree
from datetime import datetime, timedelta, timezone
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from scholarsieve.sources import scan

FEED_SCHEMA = ("entry_id string, title string, summary string, categories array<string>, published string, updated string, "
               "authors array<struct<name:string>>, pdf_url string, arrival long")
PLACES = 1_000_000  # places of one start minute

# Public feed address and XML names.
_API = "https://export.arxiv.org/api/query"
_ATOM, _SEARCH = "{http://www.w3.org/2005/Atom}", "{http://a9.com/-/spec/opensearch/1.1/}"


def query(start: datetime, end: datetime, categories) -> str:
    """Minute-grained inclusive window and a category alternative."""
    window = f"submittedDate:[{start:%Y%m%d%H%M} TO {end:%Y%m%d%H%M}]"
    return f"({' OR '.join('cat:' + c for c in categories)}) AND {window}" if categories else window


def parse_page(xml: bytes) -> tuple[int, list[tuple]]:
    """Total result count and the records of one Atom page."""
    root = ElementTree.fromstring(xml)
    rows = []
    for entry in root.iter(f"{_ATOM}entry"):
        text = lambda name: (entry.findtext(f"{_ATOM}{name}") or "").strip()
        links = {link.get("title"): link.get("href") for link in entry.iter(f"{_ATOM}link")}
        rows.append((text("id"), text("title"), text("summary"), [c.get("term") for c in entry.iter(f"{_ATOM}category")],
                     text("published"), text("updated"), [(a.findtext(f"{_ATOM}name"),) for a in entry.iter(f"{_ATOM}author")],
                     links.get("pdf") or ""))
    return int(root.findtext(f"{_SEARCH}totalResults") or 0), rows


def fetch_page(search: str, offset: int, size: int, delay: float) -> bytes:
    time.sleep(max(3.0, delay))
    url = f"{_API}?{urllib.parse.urlencode({'search_query': search, 'start': offset, 'max_results': size})}"
    with urllib.request.urlopen(url, timeout=60) as response:
        return response.read()


class _Lane(InputPartition):
    def __init__(self, shards):
        super().__init__(None)
        self.shards = shards


class _Windows:
    """Shards of one window and their rows."""

    def __init__(self, options: dict):
        self.categories = tuple(c for c in options.get("categories", "").split(",") if c)
        self.page, self.delay = int(options.get("page_size", 100)), float(options.get("delay_seconds", 3))
        self.limit, self.lanes = int(options.get("shard_limit", 10000)), int(options.get("lanes", 1))
        # "module:function" with the signature of fetch_page, for proxies and tests
        module, _, function = options.get("transport", f"{__name__}:fetch_page").partition(":")
        self.transport = (module, function)

    def _fetch(self, search: str, offset: int, size: int) -> bytes:
        module, function = self.transport
        return getattr(import_module(module), function)(search, offset, size, self.delay)

    def _count(self, start, end, categories) -> int:
        return parse_page(self._fetch(query(start, end, categories), 0, 1))[0]

    def lanes_of(self, start: datetime, end: datetime) -> list[_Lane]:
        audit, complete = scan.plan_shards(self._count, start, end, self.categories, self.limit)
        if not complete:
            raise RuntimeError("collection window cannot be split below the feed's row limit")
        leaves = [s for s in audit if s.status == "complete" and s.seen]
        return [_Lane(leaves[i::self.lanes]) for i in range(min(self.lanes, max(1, len(leaves))))]

    def read(self, partition):
        for shard in partition.shards:
            search, offset = query(shard.start, shard.end, shard.categories), 0
            first = int(shard.start.replace(tzinfo=timezone.utc).timestamp() // 60) * PLACES
            while offset < shard.seen:
                _, rows = parse_page(self._fetch(search, offset, self.page))
                if not rows:
                    raise RuntimeError("feed page ended early")
                for place, row in enumerate(rows, offset):
                    yield (*row, first + place)
                offset += len(rows)


class _Reader(_Windows, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.start, self.end = (datetime.fromisoformat(options[k]) for k in ("start", "end"))

    def partitions(self):
        return self.lanes_of(self.start, self.end)


class _StreamReader(_Windows, DataSourceStreamReader):
    """Offsets are the first minute not read yet, and nothing else is remembered: a restart goes on from its checkpoint.

    `until` ends the stream's time (default: the clock, less a minute); a long absence is one batch of many shards.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.start, self.until = options["start"], options.get("until")

    @staticmethod
    def _offset(moment: datetime) -> dict:
        return {"minute": moment.replace(second=0, microsecond=0, tzinfo=None).isoformat()}

    def initialOffset(self) -> dict:
        return self._offset(datetime.fromisoformat(self.start))

    def latestOffset(self) -> dict:
        now = datetime.now(timezone.utc) - timedelta(minutes=1)
        return max(self.initialOffset(), self._offset(datetime.fromisoformat(self.until) if self.until else now), key=lambda offset: offset["minute"])

    def partitions(self, start: dict, end: dict):
        low, high = (datetime.fromisoformat(offset["minute"]) for offset in (start, end))
        # Both ends of a search are inclusive minutes; the end minute belongs to the next batch.
        return self.lanes_of(low, high - timedelta(minutes=1)) if low < high else []

    def commit(self, end: dict) -> None:
        pass


class PaperFeed(DataSource):
    """spark.dataSource.register(PaperFeed); spark.read.format("paper_feed").option("start", ...), or spark.readStream."""

    @classmethod
    def name(cls) -> str:
        return "paper_feed"

    def schema(self) -> str:
        return FEED_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)
