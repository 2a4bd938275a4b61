"""Sources behind a paged JSON API, as a Python data source: `spark.read.format("serial_api")` and `spark.readStream` (SRC-04, SRC-18).

Options: root (an http address, or a folder of stored answers), site (what relative links are completed with), table, and for search
`q`, for the others `slug` (comma-separated). With pushdown = true, for which spark.sql.python.filterPushdown.enabled must be on, the values that
conditions on section, q or slug name decide the requests, too. Without any, the keys that the API lists (index?of=NAME) are read.

| table | requests | rows |
| --- | --- | --- |
| home | list?section=S&page=N, from page to next page | section, page, pos, slug, title, link, cover |
| search | search?q=Q&page=N, the same | q, page, pos, slug, title, link, author, cover, latest |
| detail | story?slug=S | slug, title, author, cover, status, description |
| toc | chapters?slug=S&page=N | slug, page, pos, title, url, vip |
| chapter | chapter?slug=S&page=N | slug, page, pos, url, body |

Lists end at the first page without a next token. Tables of contents tell their number of pages, so their pages are planned as
partitions of PAGES_A_TASK pages each, every one read by a task of its own. A request that finds nothing is an empty page.

Answers in a folder lie in endpoint/name=value/.../ (values encoded as in Hive's partitions), in one file or several, read through
pyarrow's file systems, so that stores that it knows (local and shared folders, HDFS, S3, GCS) serve all tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMAS = {
    "home": "section string, page int, pos int, slug string, title string, link string, cover string",
    "search": "q string, page int, pos int, slug string, title string, link string, author string, cover string, latest string",
    "detail": "slug string, title string, author string, cover string, status string, description string",
    "toc": "slug string, page int, pos int, title string, url string, vip boolean",
    "chapter": "slug string, page int, pos int, url string, body string",
}
#: What names a request in each table, and pages that a task reads in a row.
KEYS = {"home": "section", "search": "q", "detail": "slug", "toc": "slug", "chapter": "slug"}
PAGES_A_TASK = 8
#: A list that never ends would hold its task for ever.
MOST_PAGES = 100_000


def hive_name(value: str) -> str:
    """A value as Hive's folders have it."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{[]^" or ord(c) < 0x20 else c for c in value) or "__HIVE_DEFAULT_PARTITION__"


class Transport:
    """Answers to requests, from an address or a folder; null where there is none."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def get(self, endpoint: str, **query: str) -> dict | None:
        raw = self._http(endpoint, query) if self.root.startswith(("http://", "https://")) else self._stored(endpoint, query)
        if not raw:
            return None
        found = json.loads(raw)
        if not isinstance(found, dict):
            raise ValueError(f"{endpoint}: the answer is no object")
        return found

    def _http(self, endpoint: str, query: dict[str, str]) -> bytes | None:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(f"{self.root}/{endpoint}?{urlencode(query)}", timeout=30) as r:  # noqa: S310
                return r.read()
        except HTTPError as e:
            if e.code == 404:
                return None
            raise

    def _stored(self, endpoint: str, query: dict[str, str]) -> bytes | None:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{quote(self.root)}")
        folder = "/".join([base, endpoint, *(f"{k}={hive_name(v)}" for k, v in query.items())])
        names = sorted(i.path for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.is_file and not i.base_name.startswith((".", "_")))
        parts = []
        for name in names:
            with files.open_input_stream(name) as f:
                parts.append(f.read())
        return b"".join(parts) or None


def _text(x) -> str | None:
    return None if x is None else str(x)


class _Rows:
    """Requests and their rows, for readers of tables and of streams."""

    def __init__(self, options: dict[str, str]):
        self.table = options.get("table", "toc")
        if self.table not in SCHEMAS:
            raise ValueError(f"table must be one of {sorted(SCHEMAS)}")
        self.root, self.site = options["root"], options.get("site", "").rstrip("/")

    def link(self, href: str | None) -> str | None:
        return href if not href or href.startswith("http") else f"{self.site}{href}"

    def walk(self, key: str, first: int, last: int | None) -> Iterator[tuple]:
        """The rows of pages first to last, or on to the last that names a next one."""
        get, n = Transport(self.root).get, first
        endpoint = {"home": "list", "search": "search", "toc": "chapters", "chapter": "chapter"}[self.table]
        while n < first + MOST_PAGES:
            answer = get(endpoint, **{KEYS[self.table]: key, "page": str(n)}) or {}
            for pos, x in enumerate(answer.get("data") or []):
                if isinstance(x, dict) and (row := self.row(key, n, pos, x)):
                    yield row
            if last is None and not answer.get("next") or n == last:
                return
            n = n + 1 if last is not None else int(answer["next"])
        raise ValueError(f"{self.table} of {key} has more than {MOST_PAGES} pages")

    def row(self, key: str, page: int, pos: int, x: dict) -> tuple | None:
        if self.table in ("home", "search"):
            slug = _text(x.get("slug"))
            if not slug:
                return None
            head = (key, page, pos, slug, _text(x.get("name")) or slug, f"{self.site}/{slug}")
            if self.table == "home":
                return (*head, _text(x.get("img_url")) or "")
            n = x.get("chapter_count")
            return (*head, _text(x.get("author_name")) or "", _text(x.get("img_url")) or "", f"{n} chương" if n else _text(x.get("status")) or "")
        if self.table == "toc":
            return (key, page, pos, _text(x.get("name")), self.link(_text(x.get("url"))), bool(x.get("vip")))
        return (key, page, pos, self.link(_text(x.get("url"))), _text(x.get("content")))

    def detail(self, key: str) -> Iterator[tuple]:
        x = (Transport(self.root).get("story", slug=key) or {}).get("data")
        if isinstance(x, dict):
            yield (key, _text(x.get("name")) or key, _text(x.get("author_name")) or "", _text(x.get("img_url")) or "", _text(x.get("status")) or "", _text(x.get("content")) or "")

    def pages(self, key: str) -> int:
        """How many pages a table of contents has, as its first one says."""
        answer = Transport(self.root).get("chapters" if self.table == "toc" else "chapter", slug=key, page="1") or {}
        return max(1, int(answer.get("total_page") or 1)) if answer else 0


class ApiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.rows = _Rows(options)
        named = options.get(KEYS[self.rows.table])
        self.keys = None if named is None else {k for k in named.split(",") if k}

    def partitions(self):
        keys = self.keys if self.keys is not None else self._all()
        found = []
        for key in sorted(keys):
            if self.rows.table in ("toc", "chapter"):
                n = self.rows.pages(key)
                found += [InputPartition((key, i, min(n, i + PAGES_A_TASK - 1))) for i in range(1, n + 1, PAGES_A_TASK)]
            else:
                found.append(InputPartition((key, 1, None)))
        return found or [InputPartition(None)]

    def _all(self) -> set[str]:
        """The keys that the API itself lists."""
        answer = Transport(self.rows.root).get("index", of=KEYS[self.rows.table])
        if answer is None:
            raise ValueError(f"name the {KEYS[self.rows.table]} in an option or a condition: this API lists none")
        return {str(x) for x in answer.get("data") or []}

    def read(self, partition):
        if partition.value is None:
            return iter(())
        key, first, last = partition.value
        return self.rows.detail(key) if self.rows.table == "detail" else self.rows.walk(key, first, last)


class PushingApiReader(ApiReader):
    """Spark refuses a reader that takes conditions where spark.sql.python.filterPushdown.enabled is off, its default."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (KEYS[self.rows.table],):
                wanted = {str(x) for x in (f.value if isinstance(f, In) else [f.value]) if x is not None}
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f


class ApiStreamReader(DataSourceStreamReader):
    """Tables of contents that grow. The offset is the number of whole pages of each book that were read; the last page,
    which may still grow, is only read when another follows it, or the answer calls itself complete."""

    def __init__(self, options: dict[str, str]):
        self.rows = _Rows(options | {"table": "toc"})
        self.keys = sorted(k for k in options.get("slug", "").split(",") if k)
        if not self.keys:
            raise ValueError("name the slugs that the stream follows in an option")

    def initialOffset(self) -> dict:
        return {k: 0 for k in self.keys}

    def latestOffset(self) -> dict:
        get, out = Transport(self.rows.root).get, {}
        for k in self.keys:
            n = self.rows.pages(k)
            done = bool((get("chapters", slug=k, page=str(n)) or {}).get("complete")) if n else False
            out[k] = n if done else max(0, n - 1)
        return out

    def partitions(self, start: dict, end: dict):
        return [InputPartition((k, i, min(end[k], i + PAGES_A_TASK - 1))) for k in self.keys for i in range(start.get(k, 0) + 1, end.get(k, 0) + 1, PAGES_A_TASK)]

    def read(self, partition):
        return self.rows.walk(*partition.value)

    def commit(self, end: dict) -> None:
        pass


class ApiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "serial_api"

    def schema(self) -> str:
        return SCHEMAS[_Rows(self.options).table]

    def reader(self, schema) -> ApiReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (PushingApiReader if pushes else ApiReader)(dict(self.options))

    def streamReader(self, schema) -> ApiStreamReader:
        return ApiStreamReader(dict(self.options))


def contents(toc: DataFrame) -> DataFrame:
    """(slug, idx, title, url, vip) of a toc table: blank addresses out, the first of each address, numbered after that; a chapter without a name gets its number."""
    first = Window.partitionBy("slug", "url").orderBy("page", "pos")
    rows = toc.where("coalesce(url, '') <> ''").withColumn("k_", F.row_number().over(first)).where("k_ = 1")
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("slug").orderBy("page", "pos")))
    title = F.coalesce(F.nullif(F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit("")), F.concat(F.lit("Chương "), F.col("idx").cast("string")))
    return rows.select("slug", "idx", title.alias("title"), "url", "vip")


def store_answers(answers: DataFrame, root: str, endpoint: str, keys: list[str]) -> None:
    """Write (keys..., json) as the folder of answers that the source reads, a task for each file; keys are in the order of the requests' parameters."""
    answers.select(*keys, "json").repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(f"{root}/{endpoint}")
