"""Sources by name: reader functions with domains and priorities, and one as a Python data source.

A source gives four tables, each as a function of (spark, argument): search, book, chapters, content.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Source:
    id: str
    name: str
    domains: list[str] = field(default_factory=list)  #: none: takes any URL
    priority: int = 100  #: lower wins
    tables: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)


class Registry:
    """SRC-01, SRC-02."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def add(self, source: Source) -> None:
        self._sources[source.id] = source

    def all(self) -> list[Source]:
        return sorted(self._sources.values(), key=lambda s: (s.priority, s.id))

    def by_id(self, id: str) -> Source | None:
        return self._sources.get(id)

    def searchable(self) -> list[Source]:
        return [s for s in self.all() if "search" in s.tables]

    def for_url(self, url: str) -> Source | None:
        from urllib.parse import urlparse

        host = (urlparse(url).hostname or "").removeprefix("www.")
        named = (s for s in self.all() if any(host == d or host.endswith("." + d) for d in s.domains))
        return next(named, next((s for s in self.all() if not s.domains), None))

    def table(self, spark: SparkSession) -> DataFrame:
        """(source, domain, priority) for operators.catalog.route."""
        rows = [(s.id, d, s.priority) for s in self.all() for d in (s.domains or [None])]
        return spark.createDataFrame(rows, "source string, domain string, priority int")


def chapter_list(pages: DataFrame, book: str = "book_id", page: str = "page", body: str = "json") -> DataFrame:
    """(book, idx, title, url, vip) of paged JSON lists: blank URLs out, the first of each URL, numbered after that (SRC-04, WIN-03)."""
    schema = "array<struct<title:string,url:string,vip:boolean>>"
    rows = pages.select(book, page, F.posexplode(F.from_json(body, schema)).alias("pos", "c")).select(book, page, "pos", "c.*").where("coalesce(url, '') <> ''")
    first = Window.partitionBy(book, "url").orderBy(page, "pos")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    idx = F.row_number().over(Window.partitionBy(book).orderBy(page, "pos"))
    return rows.select(book, idx.alias("idx"), "title", "url", F.coalesce("vip", F.lit(False)).alias("vip"))


class ChapterSource(DataSource):
    """`spark.read.format("chapters")`: chapter files of many books under one folder, a partition each book."""

    @classmethod
    def name(cls) -> str:
        return "chapters"

    def schema(self) -> str:
        return "book_id string, idx int, title string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _ChapterReader(self.options["path"])


class _ChapterReader(DataSourceReader):
    """Folders are listed and files opened through pyarrow's file systems, so that a path may be in any store that it knows."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{quote(os.path.abspath(self.path))}")

    def partitions(self):
        from pyarrow import fs

        files, root = self._at()
        return [InputPartition(i.base_name) for i in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda i: i.path) if i.type == fs.FileType.Directory]

    def read(self, partition):
        from pyarrow import fs

        files, root = self._at()
        for i in sorted(files.get_file_info(fs.FileSelector(f"{root}/{partition.value}")), key=lambda i: i.path):
            stem, _, ext = i.base_name.rpartition(".")
            if i.is_file and ext == "txt" and stem.isdigit():
                with files.open_input_stream(i.path) as f:
                    title, _, text = f.read().decode().partition("\n")
                yield partition.value, int(stem), title.strip() or f"Chương {int(stem)}", text
