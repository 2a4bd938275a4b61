"""Plugins as table functions: a site's rules over fetched pages, called from SQL (SRC-17).

A plugin is a class with an id and four methods over a page's markup and address, each giving rows:

    search(html, url)    (title, link)                            what a list of results or a shelf names
    book(html, url)      (title, author, cover, description)      a work's page
    chapters(html, url)  (title, url)                             a page of its table of contents
    content(html, url)   (line,)                                  a chapter's lines

register(spark, Plugin) makes two functions of it:

    SELECT p.page_id, b.* FROM pages p, LATERAL <id>_page(p.html, p.url, 'book') b
    SELECT * FROM <id>_works(TABLE(SELECT work, page, html, url FROM ...) PARTITION BY (work) ORDER BY (page), 'chapters')

The second reads each work's pages in order and keeps, of rows with one link, the first; rows are numbered after that (WIN-03). What it
holds meanwhile are the links of one work.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from scriptorium.functions import html as hx

METHODS = {
    "search": ["title", "link"],
    "book": ["title", "author", "cover", "description"],
    "chapters": ["title", "url"],
    "content": ["line"],
}
#: The column that tells a method's rows apart over a work's pages; contents keep all their rows.
LINKS = {"search": 1, "chapters": 1, "book": 0}


class Plugin:
    """Rules for any site: own-host links, the generic chains of a work's page, the lines of a chapter. Sites override what they have rules for."""

    id = "generic"

    def search(self, html: str, url: str) -> Iterator[tuple]:
        return ((a["name"], a["url"]) for a in hx.anchors(html, url) if a["name"])

    def book(self, html: str, url: str) -> Iterator[tuple]:
        found = hx.book_meta(html, url)
        yield found["title"], found["author"], found["cover"], found["description"]

    def chapters(self, html: str, url: str) -> Iterator[tuple]:
        return ((a["name"], a["url"]) for a in hx.anchors(html, url) if a["chapter"])

    def content(self, html: str, url: str) -> Iterator[tuple]:
        return ((line,) for line in hx.html_to_lines(html))


def method_of(argument: AnalyzeArgument) -> str:
    """The method that a call names; it decides the columns, so it must be a constant."""
    if argument.isTable or not argument.isConstantExpression or argument.value not in METHODS:
        raise ValueError(f"the method must be one of {sorted(METHODS)}, as a constant")
    return argument.value


def page_function(plugin: type[Plugin]):
    """A table function (html, url, method) of one page's rows."""

    @udtf
    class PageFunction:
        def __init__(self, analyzed=None):
            self.plugin = plugin()

        @staticmethod
        def analyze(html: AnalyzeArgument, url: AnalyzeArgument, method: AnalyzeArgument) -> AnalyzeResult:
            schema = StructType().add("pos", IntegerType())
            for name in METHODS[method_of(method)]:
                schema = schema.add(name, StringType())
            return AnalyzeResult(schema)

        def eval(self, html, url, method):
            for pos, row in enumerate(getattr(self.plugin, method)(html or "", url or "")):
                yield (pos, *row)

    return PageFunction


def works_function(plugin: type[Plugin]):
    """A table function (TABLE with work, page, html, url; method) of whole works."""

    @udtf
    class WorksFunction:
        def __init__(self, analyzed=None):
            self.plugin, self.seen, self.n = plugin(), set(), 0

        @staticmethod
        def analyze(pages: AnalyzeArgument, method: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable:
                raise ValueError("give the pages as TABLE(...) PARTITION BY (work) ORDER BY (page)")
            if missing := {"work", "page", "html", "url"} - set(pages.dataType.fieldNames()):
                raise ValueError(f"the table lacks {sorted(missing)}")
            schema = StructType().add("work", pages.dataType["work"].dataType).add("page", pages.dataType["page"].dataType).add("idx", IntegerType())
            for name in METHODS[method_of(method)]:
                schema = schema.add(name, StringType())
            return AnalyzeResult(schema)

        def eval(self, pages, method):
            at = LINKS.get(method)
            for row in getattr(self.plugin, method)(pages["html"] or "", pages["url"] or ""):
                if at is not None:
                    if row[at] in self.seen:
                        continue
                    self.seen.add(row[at])
                self.n += 1
                yield (pages["work"], pages["page"], self.n, *row)

    return WorksFunction


def register(spark: SparkSession, plugin: type[Plugin]) -> None:
    """Both functions of a plugin, under its id; a plugin without one of the four methods is refused."""
    if lacking := [m for m in METHODS if not callable(getattr(plugin, m, None))]:
        raise TypeError(f"{plugin.__name__} lacks {lacking}")
    spark.udtf.register(f"{plugin.id}_page", page_function(plugin))
    spark.udtf.register(f"{plugin.id}_works", works_function(plugin))
