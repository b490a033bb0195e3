"""A search service as a Spark data source: partitions by term, pushed-down terms, offsets for streams.

``register(spark, client)`` makes ``spark.read.format("issue_search")`` and
``spark.readStream.format("issue_search")`` read from a client, any picklable
object with ``size(term)``, the results there are so far, and ``rows(term,
start, stop)``, an iterator of dicts.  ``Recordings`` is one for recorded
JSON lines, as offline runs use it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

FORMAT = "issue_search"
FIELDS = ("url", "title", "body", "state")
SCHEMA = "query string, " + ", ".join(f"{f} string" for f in FIELDS)
#: Results of a term that one task asks for.
CHUNK = 10_000


@dataclass(frozen=True)
class Recordings:
    """Results recorded as <folder>/<term>.jsonl, a file or a folder of files, in any file system that Arrow reads."""

    folder: str

    def _lines(self, term: str) -> Iterator[str]:
        system, root = fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        path = f"{root}/{term}.jsonl"
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            return
        parts = [info.path] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith(("_", ".")))
        for part in parts:
            with system.open_input_stream(part) as raw:
                held = b""
                while block := raw.read(1 << 20):
                    *lines, held = (held + block).split(b"\n")
                    yield from (x.decode("utf-8", "replace") for x in lines if x.strip())
                if held.strip():
                    yield held.decode("utf-8", "replace")

    def size(self, term: str) -> int:
        return sum(1 for _ in self._lines(term))

    def rows(self, term: str, start: int, stop: int) -> Iterator[dict]:
        for at, line in enumerate(self._lines(term)):
            if at >= stop:
                return
            if at >= start:
                try:
                    found = json.loads(line)
                except ValueError:
                    continue
                if isinstance(found, dict):
                    yield found


@dataclass
class Range(InputPartition):
    """Results [start, stop) of a term."""

    term: str
    start: int
    stop: int


def _ranges(term: str, start: int, stop: int) -> list[Range]:
    return [Range(term, at, min(at + CHUNK, stop)) for at in range(start, stop, CHUNK)]


def _read(client: Any, part: Range) -> Iterator[tuple]:
    for row in client.rows(part.term, part.start, part.stop):
        yield (part.term, *[None if row.get(f) is None else str(row[f]) for f in FIELDS])


class _Reader(DataSourceReader):
    def __init__(self, client: Any, terms: list[str]):
        self.client, self.terms = client, terms

    def pushFilters(self, filters: list) -> Iterator:
        """Terms asked for by equality or a list are all that is searched; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query",):
                self.terms = [t for t in self.terms if t == f.value]
            elif isinstance(f, In) and f.attribute == ("query",):
                self.terms = [t for t in self.terms if t in f.value]
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [r for t in self.terms for r in _ranges(t, 0, self.client.size(t))] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _read(self.client, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the number of results taken of each term, so a restart goes on where the checkpoint ends."""

    def __init__(self, client: Any, terms: list[str]):
        self.client, self.terms = client, terms

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.terms, 0)

    def latestOffset(self) -> dict:
        return {t: self.client.size(t) for t in self.terms}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for t in end for r in _ranges(t, start.get(t, 0), end[t])]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _read(self.client, partition)


def register(spark: SparkSession, client: Any, name: str = FORMAT) -> None:
    """Make the format ``name`` read from ``client``; its option ``terms`` is a JSON list of search terms."""

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def _terms(self) -> list[str]:
            return list(dict.fromkeys(json.loads(self.options.get("terms", "[]"))))

        def reader(self, schema) -> DataSourceReader:
            return _Reader(client, self._terms())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(client, self._terms())

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Search)
