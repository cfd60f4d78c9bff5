"""Paged JSON sources over HTTP, as a Spark data source: one partition a query, pages followed until one has no next.

spark.dataSource.register(Pages); spark.read.format("pages").option("url", "https://host/search?q={query}").option("queries", json).load()
gives (query, page, raw): a row a record. Fields of a page: ``items`` (its records) and ``next`` (the address of the next page). A source that
needs credentials gets them as a header whose value is an option; options are never written anywhere.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Query(InputPartition):
    def __init__(self, text: str):
        self.text = text


def fetch(url: str, header: str | None, value: str | None, tries: int, wait: float) -> dict:
    """A page; errors are tried again after growing waits, and raised if they stay."""
    for k in range(tries):
        try:
            request = urllib.request.Request(url, headers={header: value} if header and value else {})
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.loads(answer.read().decode("utf-8", "replace"))
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)
    return {}


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        get = options.get
        self.url, self.queries, self.items, self.next = get("url"), json.loads(get("queries", "[]")), get("items", "items"), get("next", "next")
        self.header, self.value, self.tries, self.wait, self.most = get("header"), get("value"), int(get("tries", 3)), float(get("wait", 1.0)), int(get("pages", 10_000))

    def partitions(self) -> list[InputPartition]:
        return [Query(q) for q in self.queries]

    def read(self, partition: Query):
        url, page = self.url.replace("{query}", urllib.parse.quote(partition.text)), 0
        while url:
            if page >= self.most:
                raise RuntimeError(f"more than {self.most} pages for {partition.text}")
            answer = fetch(url, self.header, self.value, self.tries, self.wait)
            for record in answer.get(self.items) or []:
                yield partition.text, page, json.dumps(record)
            more = answer.get(self.next)
            url, page = urllib.parse.urljoin(url, more) if more else None, page + 1


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "query string, page int, raw string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)
