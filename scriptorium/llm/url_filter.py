"""Block decisions for URLs, carried to their aliases.

Redirects (meta refresh) and canonical links join URLs that are the same page. Connected components over
these edges, found by distributed star contraction, carry a block from any member to all others; an
explicit allow takes precedence. A URL that fits a rule itself keeps that rule's verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import components
from scriptorium.session import durable


class Rule(NamedTuple):
    action: str  #: allow or block
    host: str
    path: str


# The rules of the registered query: fixed values.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A to Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _address(url: Column) -> Column:
    """Host, path and query: what the nodes of the graph are named by. Scheme and fragment don't count."""
    query = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.concat(url_host(url), url_path(url), query)


def _rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (size, allows, rule), or null; of equally long ones an allow wins.

    The rules are a literal of the plan: for lists, not for tables of rules.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,allows:int,rule:string>")
    table = F.array(*(F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(int(r.action == "allow")).alias("allows")) for r in rules))
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(
        F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), r["allows"].alias("allows"), F.concat(r["host"], r["path"]).alias("rule")))
    )


def address(url: str) -> str:
    """The same in Python."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url)
    return m[1].translate(str.maketrans(_UPPER, _LOWER)) + m[2] + (m[3] or "") if m else ""


class _Links(HTMLParser):
    """Where a page says that it is the same as another: canonical links and refreshes, and what these are relative to."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []
        self.base = ""

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in attrs}
        if tag == "base" and not self.base:
            self.base = named.get("href", "").strip()
        if tag == "link" and "canonical" in named.get("rel", "").lower().split():
            self.found.append(named.get("href", ""))
        if tag == "meta" and named.get("http-equiv", "").strip().lower() == "refresh":
            if m := re.search(r"""(?is)url\s*=\s*["']?([^"'\s]+)""", named.get("content", "")):
                self.found.append(m[1])

    handle_startendtag = handle_starttag

    def parse_marked_section(self, i, report=1):
        """Marked sections that aren't well formed are passed over like comments: up to the next >."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1


def same_as(url: str, html: str) -> Iterator[str]:
    """The whole URLs that a page names as its own."""
    parser = _Links()
    parser.feed(html)
    for goal in filter(None, map(str.strip, parser.found)):
        try:
            yield urljoin(urljoin(url, parser.base), goal)
        except ValueError:  # not a URL
            continue


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        src, dst = [], []
        for url, html in zip(*batch.columns):
            a = address(url.as_py())
            for goal in same_as(url.as_py(), html.as_py()):
                b = address(goal)
                if a and b and a != b:
                    src.append(a)
                    dst.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], names=["src", "dst"])


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) addresses: from a page to its canonical link and to where it refreshes. Only pages that can have such a tag are parsed."""
    rows = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).where("u IS NOT NULL")
    return rows.where(F.col("h").rlike(r"(?i)<link[\s/]|http-equiv")).mapInArrow(_edges, "src string, dst string").distinct()


def judge_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, component), a row for each input row.

    redirects: further (src, dst) URLs, as from a crawl's log. A page without a rule is blocked when its
    component has a blocked URL and no allowed one; else it is allowed. Null URLs and those without ://
    have an empty host and path, no rule and no aliases. component is null for a URL without aliases.
    Repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumn("found", _rule_of(F.col("host"), F.col("path"), rules))
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(_address(F.col("src")), _address(F.col("dst"))).where("src <> '' AND dst <> ''")).distinct()
    nodes = durable(components(edges), "aliases")
    as_url = F.concat(F.lit("http://"), F.col("node"))
    own = _rule_of(url_host(as_url), url_path(as_url), rules)
    groups = nodes.select("component", own["allows"].alias("a")).groupBy("component").agg(F.max("a").alias("allowed"), F.min("a").alias("blocked"))
    blocked = F.coalesce((F.col("allowed") == 0), F.lit(False))
    aliases = nodes.join(groups, "component").select("node", "component", blocked.alias("spread"))
    # Rows without a host match nothing; a key of their own keeps them from meeting in one task.
    alone = F.concat(F.lit("\0"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    rows = rows.withColumn("address", F.when(F.col("host") == "", alone).otherwise(_address(F.col("url"))))
    verdict = F.when(F.col("found").isNotNull(), F.when(F.col("found.allows") == 1, "allow").otherwise("block")).when(F.col("spread"), "block").otherwise("allow")
    return rows.join(aliases, F.col("address") == F.col("node"), "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "component")
