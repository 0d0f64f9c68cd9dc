"""A Python data source for paged services. Without a network it reads pages saved as JSON-lines files; a service is
added by giving the fetch function of a subclass."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, query: str, number: int):
        self.query, self.number = query, number


class PagedReader(DataSourceReader):
    """One partition a query and page; each page is fetched by the executor that reads it and retried as its task is."""

    def __init__(self, schema, options: dict, fetch):
        self.names, self.options, self.fetch = [f.name for f in schema.fields], options, fetch

    def partitions(self) -> list[Page]:
        queries = [q for q in self.options.get("queries", "").split("|") if q]
        return [Page(q, i) for q in queries for i in range(int(self.options.get("pages", "1")))]

    def read(self, part: Page) -> Iterator[tuple]:
        for row in self.fetch(self.options, part.query, part.number):
            yield tuple(row.get(n) for n in self.names)


def saved_page(options: dict, query: str, number: int) -> list[dict]:
    """Lines of <path>/<query>-<number>.jsonl; a page that isn't there is empty, as after the last one."""
    try:
        with open(f"{options['path']}/{query}-{number}.jsonl") as f:
            return [json.loads(line) for line in f if line.strip()]
    except FileNotFoundError:
        return []


class PagedSource(DataSource):
    """spark.read.format("paged").schema(...).options(path=, queries="a|b", pages=3).load() after spark.dataSource.register."""

    fetch = staticmethod(saved_page)

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, title string, published_at string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, dict(self.options), type(self).fetch)


#: The statuses after which a request is made again, besides 500 to 599.
AGAIN = (408, 429)


class ServiceError(Exception):
    """A failed request; status None: the network failed."""

    def __init__(self, status: int | None, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


def should_retry(error: Exception, attempt: int, most: int = 3) -> bool:
    """Whether attempt number `attempt` (from 0) that failed is made again: after network failures and passing statuses."""
    if attempt >= most:
        return False
    if isinstance(error, ServiceError):
        return error.status is None or error.status in AGAIN or 500 <= error.status < 600
    return isinstance(error, (ConnectionError, TimeoutError))


def delay(attempt: int, first: float = 1.0, factor: float = 2.0, longest: float = 300.0) -> float:
    return min(longest, first * factor**attempt)


def patient(fetch, most: int = 3, first: float = 1.0, factor: float = 2.0, interval: float = 0.0, sleep=time.sleep, clock=time.monotonic):
    """fetch with retries after growing pauses, and at least `interval` seconds between requests of one task."""
    last = [float("-inf")]

    def call(options: dict, query: str, number: int) -> list[dict]:
        attempt = 0
        while True:
            wait = last[0] + interval - clock()
            if wait > 0:
                sleep(wait)
            last[0] = clock()
            try:
                return fetch(options, query, number)
            except Exception as e:
                if not should_retry(e, attempt, most):
                    raise
                sleep(delay(attempt, first, factor))
                attempt += 1

    return call


def until(pages, stop) -> Iterator[dict]:
    """Rows of pages in order, up to the first page that is empty or for which stop(page) holds, which is the last."""
    for page in pages:
        yield from page
        if not page or stop(page):
            return
