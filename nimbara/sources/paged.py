"""A Spark data source for paged JSON endpoints, one task a page.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").option("url", "https://host/data?page={page}").option("pages", 20).load()

Options: url (with {page}), pages, first (0), items (key of the record list;
empty: the body is the list), token (bearer), retries (4), backoff (seconds).
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = {k.lower(): v for k, v in dict(options).items()}

    def partitions(self) -> list[Page]:
        first = int(self.options.get("first", 0))
        return [Page(first + i) for i in range(int(self.options.get("pages", 1)))]

    def fetch(self, url: str):
        tries = int(self.options.get("retries", 4))
        head = {"Authorization": f"Bearer {self.options['token']}"} if self.options.get("token") else {}
        for i in range(tries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=60) as r:
                    return json.loads(r.read())
            except (OSError, ValueError):
                if i == tries:
                    raise
                time.sleep(float(self.options.get("backoff", 1.0)) * 2**i)

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        body = self.fetch(self.options["url"].replace("{page}", str(partition.number)))
        for item in body[self.options["items"]] if self.options.get("items") else body:
            yield partition.number, json.dumps(item)
