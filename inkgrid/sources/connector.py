"""A Spark data source of element JSON: one document to a file, one partition to a document, page filters pushed down.

`spark.dataSource.register(DrawingPages)` makes the format "drawing_pages" known.  Options: path (a folder that all executors see), and
keys, a comma-separated list of documents.  A key without a file is a row of nulls besides its id, as a provider that finds
nothing answers null; without keys every file of the folder is a document.  Read as a stream, new documents of the folder are the micro-batches.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "pdf_id string, page_number int, width double, height double, elems string"


@dataclass
class Document(InputPartition):
    key: str
    path: str | None


def _rows(document: Document, wanted: list[Filter]) -> Iterator[tuple]:
    if document.path is None:
        yield document.key, None, None, None, None
        return
    with open(document.path, encoding="utf-8") as lines:
        for line in lines:
            if line.strip():
                page = json.loads(line)
                if all(_holds(f, page.get("page_number")) for f in wanted):
                    yield document.key, page.get("page_number"), page.get("width"), page.get("height"), json.dumps(page.get("elems", []))


def _holds(f: Filter, number: int | None) -> bool:
    if number is None:
        return False
    tests = {EqualTo: lambda: number == f.value, In: lambda: number in f.value, GreaterThan: lambda: number > f.value, GreaterThanOrEqual: lambda: number >= f.value, LessThan: lambda: number < f.value, LessThanOrEqual: lambda: number <= f.value}
    return tests[type(f)]()


class PagesReader(DataSourceReader):
    """Plans a partition for each wanted document; filters on the page are applied while its file is read, those on the id before."""

    def __init__(self, options: dict) -> None:
        self.path, self.keys = options["path"], options.get("keys")
        self.pages: list[Filter] = []
        self.ids: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("page_number",):
                self.pages.append(f)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("pdf_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = values if self.ids is None else self.ids & values
            else:
                yield f

    def partitions(self) -> list[Document]:
        there = {n[: -len(".json")]: os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".json")}
        keys = [k.strip() for k in self.keys.split(",")] if self.keys else sorted(there)
        return [Document(k, there.get(k)) for k in keys if self.ids is None or k in self.ids] or [Document("", None)]

    def read(self, partition: Document) -> Iterator[tuple]:
        if partition.key:
            if partition.path is None and self.pages:  # a null page fulfils no filter
                return
            yield from _rows(partition, self.pages)


class PagesStream(DataSourceStreamReader):
    """Documents in the order of their names, read on executors; the offset is the last name there is."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def _names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.path) if n.endswith(".json"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"last": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Document]:
        return [Document(n[: -len(".json")], os.path.join(self.path, n)) for n in self._names() if start["last"] < n <= end["last"]]

    def read(self, partition: Document) -> Iterator[tuple]:
        yield from _rows(partition, [])


class DrawingPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "drawing_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(self.options)

    def streamReader(self, schema: StructType) -> PagesStream:  # noqa: N802
        return PagesStream(self.options)
