"""Paged sources as a Spark data source: queries are partitions, pages follow each other by tokens. The fetcher is given, so
nothing here knows a network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: (query, token or None for the first page) -> (rows as tuples, token of the next page or None)
Fetch = Callable[[str, Any], tuple[list[tuple], Any]]


class Query(InputPartition):
    def __init__(self, query: str):
        super().__init__(query)
        self.query = query


def pages(fetch: Fetch, query: str, retries: int, wait: float, most: int | None = None) -> Iterator[tuple]:
    """The rows of a query's pages. A page that fails is asked for again, `retries` times, after waits that double."""
    token, left = None, most
    while left is None or left > 0:
        for attempt in range(retries + 1):
            try:
                rows, token = fetch(query, token)
                break
            except Exception:  # noqa: BLE001 whatever the fetcher's library raises
                if attempt == retries:
                    raise
                time.sleep(wait * 2**attempt)
        rows = rows if left is None else rows[:left]
        yield from rows
        left = None if left is None else left - len(rows)
        if token is None:
            return


def paged(name: str, schema: str, fetch: Fetch, queries: list[str]) -> type[DataSource]:
    """A data source for spark.dataSource.register; spark.read.format(name) then gives the rows of all queries.

    Options: retries (3), wait (seconds before the first retry, 0.5), most (rows of each query; all if unset).
    A query is a partition, so a task that is lost starts its query again.
    """
    kept = cloudpickle.dumps(fetch)

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.retries, self.wait = int(options.get("retries", 3)), float(options.get("wait", 0.5))
            self.most = int(options["most"]) if "most" in options else None

        def partitions(self) -> list[InputPartition]:
            return [Query(q) for q in queries]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from pages(cloudpickle.loads(kept), partition.query, self.retries, self.wait, self.most)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Paged
