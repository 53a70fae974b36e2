"""A data source of one's own for paged services, batch and stream: pages after a cursor, which Spark keeps in its checkpoint."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

T = TypeVar("T")
SCHEMA = "id string, url string, title string, tags array<string>, added string, public boolean"
#: How a named service is asked: (settings, cursor, most) gives its items after the cursor in order, and the next cursor.
Fetch = Callable[[dict, str, int], tuple[list[dict], str]]
SERVICES: dict[str, Fetch] = {}


def service(name: str) -> Callable[[Fetch], Fetch]:
    """Registers how a service is asked, under its name."""

    def add(f: Fetch) -> Fetch:
        SERVICES[name] = f
        return f

    return add


@service("folder")
def from_folder(options: dict, cursor: str, most: int) -> tuple[list[dict], str]:
    """Items of JSON files in a folder (each a list), file by file in order of name; the cursor is the last file read."""
    items: list[dict] = []
    for f in sorted(Path(options["path"]).glob("*.json")):
        if f.name > cursor:
            items += json.loads(f.read_text("utf-8"))
            cursor = f.name
            if len(items) >= most:
                break
    return items, cursor


def with_retry(ask: Callable[[], T], attempts: int = 4, first: float = 0.2, most: float = 10.0, wait: Callable[[float], None] = time.sleep) -> T:
    """What ask gives; after a timeout or a broken connection it is asked again, after waits that double up to most, each a random part of a half longer or
    shorter. Other errors, and the last one, are raised."""
    delay = first
    for k in range(attempts):
        try:
            return ask()
        except (TimeoutError, ConnectionError):
            if k == attempts - 1:
                raise
            wait(delay * random.uniform(0.5, 1.5))
            delay = min(delay * 2, most)
    raise ValueError("attempts must be 1 or more")


def _rows(items: list[dict]) -> Iterator[tuple]:
    for x in items:
        yield tuple(x.get(c) for c in ("id", "url", "title", "tags", "added", "public"))


class _Batch(DataSourceReader):
    def __init__(self, fetch: Fetch, options: dict) -> None:
        self.fetch, self.options = fetch, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cursor, most = self.options.get("cursor", ""), int(self.options.get("pageSize", "1000"))
        while True:
            items, following = with_retry(lambda at=cursor: self.fetch(self.options, at, most))
            yield from _rows(items)
            if following == cursor:
                return
            cursor = following


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Fetch, options: dict) -> None:
        self.fetch, self.options = fetch, options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.options.get("cursor", "")}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        items, following = with_retry(lambda: self.fetch(self.options, start["cursor"], int(self.options.get("pageSize", "1000"))))
        return iter(list(_rows(items))), {"cursor": following}  # what is read here goes to the tasks as it is

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        cursor = start["cursor"]
        while cursor < end["cursor"]:
            items, following = with_retry(lambda at=cursor: self.fetch(self.options, at, int(self.options.get("pageSize", "1000"))))
            yield from _rows(items)
            if following == cursor:
                return
            cursor = following


class PulledSource(DataSource):
    """spark.read(Stream).format("pulled").option("service", name): the items of a registered service; service "folder" needs a path."""

    @classmethod
    def name(cls) -> str:
        return "pulled"

    def schema(self) -> str:
        return SCHEMA

    def _fetch(self) -> Fetch:
        name = self.options.get("service", "folder")
        if name not in SERVICES:
            raise ValueError(f"no service {name}")
        return SERVICES[name]

    def reader(self, schema: StructType) -> DataSourceReader:  # noqa: ARG002
        return _Batch(self._fetch(), dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: ARG002, N802
        return _Stream(self._fetch(), dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(PulledSource)
