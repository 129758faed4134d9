"""An archive's services as tables: seeds, collection metadata, capture indexes and pages.

A ``client`` answers requests: ``client(path, params) -> (status, headers, body)``. It is given as the name of a
factory (``module:function``), as readers run in Python workers: one partition a collection, paced within it.
"""

from __future__ import annotations

import importlib
import json
import random
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Client = Callable[[str, dict], tuple[int, dict, bytes]]


def retry_after_seconds(value: str | None, now: datetime | None = None) -> float:
    """Seconds that a Retry-After header asks for: a number or a date; 0 for anything else or what has passed."""
    if value is None:
        return 0.0
    try:
        return max(0.0, float(value.strip()))
    except ValueError:
        pass
    try:
        at = parsedate_to_datetime(value.strip())
    except (TypeError, ValueError):
        return 0.0
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return max(0.0, (at - (now or datetime.now(UTC))).total_seconds())


class Pacing:
    """Time between requests: it grows when the archive is busy, shrinks while it is not, and a cooldown is shared by all."""

    def __init__(self, least: float = 2.0, most: float = 60.0, cooldown: tuple[float, float] = (300.0, 1800.0), clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.least, self.most, self.cooldown, self.clock, self.sleep = least, most, cooldown, clock, sleep
        self.interval, self.next_at, self.failures = least, 0.0, 0
        self.failed: dict[str, int] = {}

    def wait(self) -> None:
        now = self.clock()
        if now < self.next_at:
            self.sleep(self.next_at - now)
        self.next_at = max(now, self.next_at) + self.interval

    def good(self) -> None:
        self.failures = 0
        self.interval = max(self.least, self.interval * 0.9)

    def busy(self, asked: float = 0.0, what: str | None = None) -> None:
        self.failures += 1
        self.interval = min(self.most, self.interval * 2)
        if what is not None:
            self.failed[what] = self.failed.get(what, 0) + 1
        pause = max(asked, self.interval)
        if self.failures >= 3:
            pause = max(pause, min(self.cooldown[1], self.cooldown[0] * 2 ** (self.failures - 3)))
        self.next_at = max(self.next_at, self.clock() + pause)


def fetch(client: Client, path: str, params: dict, pacing: Pacing, retries: int = 4, base: float = 1.5, malformed: int = 3) -> bytes | None:
    """The body of an answer; None for what is not there. Busy answers and broken ones are asked for again, later."""
    broken = 0
    for attempt in range(retries + 1):
        pacing.wait()
        try:
            status, headers, body = client(path, params)
        except (ConnectionError, TimeoutError):
            status, headers, body = 503, {}, b""
        except ValueError:  # an answer that is no answer
            broken += 1
            if broken >= malformed:
                raise
            status, headers, body = 503, {}, b""
        if status == 200:
            pacing.good()
            return body
        if status in (404, 410):
            pacing.good()
            return None
        if status != 429 and status < 500:
            raise RuntimeError(f"{path}: {status}")
        pacing.busy(max(retry_after_seconds(headers.get("Retry-After")), base**attempt + random.random() * 0.1), path)
    raise RuntimeError(f"{path}: no answer after {retries} retries")


def seed_pages(client: Client, collection: int, pacing: Pacing, page: int = 20, most: int | None = None) -> Iterator[dict]:
    """Seeds of a collection, a page after the other, until one is empty or short, or there are enough."""
    at = 0
    while most is None or at < most:
        body = fetch(client, "/api/seed", {"collection": collection, "limit": page, "offset": at}, pacing)
        rows = json.loads(body) if body else []
        for r in rows[: None if most is None else most - at]:
            yield r
        at += len(rows)
        if len(rows) < page:
            return


def capture_lines(client: Client, collection: int, url: str, pacing: Pacing, match: str = "exact", first: str | None = None, last: str | None = None, limit: int | None = None, collapse: str | None = None) -> Iterator[str]:
    """Lines of the capture index. Dates and limit go to the archive for exact matches; else dates are tested here, before the limit."""
    if match not in ("exact", "prefix", "host", "domain"):
        raise ValueError(f"no such match: {match}")
    here = match != "exact" and bool(first or last)
    if here and collapse:
        raise ValueError("collapsing comes before the dates are tested")
    params = {"url": url, "matchType": match} | ({"collapse": collapse} if collapse else {})
    if not here:
        params |= {k: v for k, v in (("from", first), ("to", last), ("limit", limit)) if v}
    body = fetch(client, f"/{collection}/timemap/cdx", params, pacing) or b""
    found = 0
    for line in body.decode("utf-8", "replace").splitlines():
        parts = line.split()
        if len(parts) < 7 or here and (first and parts[1] < first or last and parts[1][: len(last)] > last):
            continue
        if limit is not None and found >= limit:
            return
        found += 1
        yield line


def _client(name: str) -> Client:
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)()


class _Collection(InputPartition):
    def __init__(self, collection: int, urls: tuple[str, ...] = ()):
        self.collection, self.urls = collection, urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        urls = tuple(u for u in self.options.get("urls", "").split(" ") if u)
        return [_Collection(int(c), urls) for c in self.options["collections"].split(",")]

    def read(self, partition: _Collection) -> Iterator[tuple]:
        o, client = self.options, _client(self.options["client"])
        pacing = Pacing(float(o.get("interval", 2.0)))
        most = int(o["most"]) if "most" in o else None
        if o.get("table", "seeds") == "seeds":
            for s in seed_pages(client, partition.collection, pacing, most=most):
                yield (partition.collection, str(s.get("id")), s.get("url"), bool(s.get("active", True)), json.dumps(s, sort_keys=True))
        elif o["table"] == "metadata":
            body = fetch(client, f"/api/collection/{partition.collection}", {}, pacing) or b"{}"
            m = json.loads(body)
            yield (partition.collection, str(m.get("id")), m.get("name"), True, json.dumps(m, sort_keys=True))
        else:
            for url in partition.urls:
                for line in capture_lines(client, partition.collection, url, pacing, o.get("match", "exact"), o.get("first"), o.get("last"), most):
                    yield (partition.collection, None, url, True, line)


class ArchiveSource(DataSource):
    """``spark.read.format("textloom_archive")`` with options client, collections (1,2,...), table (seeds, metadata or captures).

    Seeds and captures take ``most``; captures also ``urls`` (separated by spaces), ``match``, ``first`` and ``last``.
    Rows are (collection_id, id, url, active, body); a capture's body is its line of the index, for files.cdx().
    """

    @classmethod
    def name(cls) -> str:
        return "textloom_archive"

    def schema(self) -> str:
        return "collection_id long, id string, url string, active boolean, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def probe(spark, client: str, collections: list[int], seeds: int = 5):
    """(metadata, first seeds) of collections, to look at."""
    spark.dataSource.register(ArchiveSource)
    read = spark.read.format("textloom_archive").option("client", client).option("collections", ",".join(map(str, collections)))
    return read.option("table", "metadata").load(), read.option("table", "seeds").option("most", str(seeds)).load()
