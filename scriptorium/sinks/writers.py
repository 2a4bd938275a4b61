"""Books as text and EPUB, days of news as partitions and digests."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import safe_name
from scriptorium.operators.batching import chunk


def volumes(chapters: DataFrame, book: str = "book_id", idx: str = "idx", size: int = 0) -> DataFrame:
    """Chapters with their volume from 1; no size, one volume (WIN-13)."""
    return chapters.withColumn("volume", (chunk(F.col(idx), [book], size) + 1).cast("int") if size > 0 else F.lit(1))


def text_files(books: DataFrame, chapters: DataFrame, size: int = 0, book: str = "book_id") -> DataFrame:
    """(book, volume, name, text): title, author and address, 60 signs, then each chapter after two blank lines over 40 dashes (SNK-01).

    books are (book, title, author, url), chapters (book, idx, title, lines).
    """
    body = F.concat(F.lit("\n\n\n"), F.col("title"), F.lit("\n" + "-" * 40), F.when(F.size("lines") > 0, F.concat(F.lit("\n"), F.array_join("lines", "\n"))).otherwise(""))
    rows = volumes(chapters, book, size=size).select(book, "volume", "idx", body.alias("part"))
    parts = rows.groupBy(book, "volume").agg(F.sort_array(F.collect_list(F.struct("idx", "part"))).alias("parts"))
    many = parts.groupBy(book).agg((F.max("volume") > 1).alias("many"))
    head = F.concat(
        "title", F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit("\nTac gia: "), "author")).otherwise(""), F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("\nNguon: "), "url")).otherwise(""), F.lit("\n" + "=" * 60)
    )
    name = F.concat(safe_name(F.col("title")), F.when(F.col("many"), F.concat(F.lit(" - Tap "), F.col("volume").cast("string"))).otherwise(""), F.lit(".txt"))
    joined = parts.join(many, book).join(books, book)
    return joined.select(book, "volume", name.alias("name"), F.concat(head, F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("text"))


_CONTAINER = '<?xml version="1.0" encoding="utf-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"{extra}><head><title>{title}</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body>{body}</body></html>'


def build_epub(book: dict, chapters: list[tuple[str, list[str]]], volume: int | None = None) -> bytes:
    """EPUB 3: the type stored first, container, package, navigation in both forms, an information page and a page a chapter (SNK-02)."""
    e = lambda s: html.escape(s or "", quote=False)
    title = book["title"] + (f" - Tap {volume}" if volume else "")
    files: dict[str, str | bytes] = {"OEBPS/style.css": "p { margin: 0 0 1em; }\n"}
    items = ['<item id="css" href="style.css" media-type="text/css"/>', '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', '<item id="info" href="info.xhtml" media-type="application/xhtml+xml"/>']
    if book.get("cover"):
        ext = book.get("cover_ext") or "jpg"
        kind = "image/jpeg" if ext == "jpg" else f"image/{ext}"
        files[f"OEBPS/cover.{ext}"] = bytes(book["cover"])
        items.append(f'<item id="cover" href="cover.{ext}" media-type="{kind}" properties="cover-image"/>')
    about = "".join(f"<p>{e(x)}</p>" for x in (book.get("author"), book.get("description"), book.get("url")) if x)
    files["OEBPS/info.xhtml"] = _PAGE.format(extra="", title=e(title), body=f"<h1>{e(title)}</h1>{about}")
    spine, nav, points = ['<itemref idref="info"/>'], [], []
    for i, (name, lines) in enumerate(chapters, 1):
        page = f"c{i:05d}"
        files[f"OEBPS/{page}.xhtml"] = _PAGE.format(extra="", title=e(name), body=f"<h2>{e(name)}</h2>" + "".join(f"<p>{e(x)}</p>" for x in lines))
        items.append(f'<item id="{page}" href="{page}.xhtml" media-type="application/xhtml+xml"/>')
        spine.append(f'<itemref idref="{page}"/>')
        nav.append(f'<li><a href="{page}.xhtml">{e(name)}</a></li>')
        points.append(f'<navPoint id="{page}" playOrder="{i}"><navLabel><text>{e(name)}</text></navLabel><content src="{page}.xhtml"/></navPoint>')
    files["OEBPS/nav.xhtml"] = _PAGE.format(extra=' xmlns:epub="http://www.idpf.org/2007/ops"', title=e(title), body=f'<nav epub:type="toc"><ol>{"".join(nav)}</ol></nav>')
    files["OEBPS/toc.ncx"] = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{e(title)}</text></docTitle><navMap>{"".join(points)}</navMap></ncx>'
    files["OEBPS/content.opf"] = (
        '<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{e(book.get("url") or title)}</dc:identifier><dc:title>{e(title)}</dc:title><dc:language>{e(book.get("lang") or "vi")}</dc:language><dc:creator>{e(book.get("author"))}</dc:creator>'
        f'<dc:description>{e(book.get("description"))}</dc:description></metadata><manifest>{"".join(items)}</manifest><spine toc="ncx">{"".join(spine)}</spine></package>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        stamp = (1980, 1, 1, 0, 0, 0)  # the same input gives the same bytes
        z.writestr(zipfile.ZipInfo("mimetype", stamp), "application/epub+zip", zipfile.ZIP_STORED)
        for name, data in {"META-INF/container.xml": _CONTAINER, **files}.items():
            z.writestr(zipfile.ZipInfo(name, stamp), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def epub_files(books: DataFrame, chapters: DataFrame, size: int = 0, book: str = "book_id") -> DataFrame:
    """(book, volume, name, content): an EPUB for each volume; a volume's chapters are one group."""
    rows = volumes(chapters, book, size=size).groupBy(book, "volume").agg(F.sort_array(F.collect_list(F.struct("idx", "title", "lines"))).alias("chapters"))
    many = rows.groupBy(book).agg((F.max("volume") > 1).alias("many"))
    extra = [c for c in ("author", "url", "description", "cover", "cover_ext", "lang") if c in books.columns]
    rows = rows.join(many, book).join(books.select(book, "title", *extra), book).withColumn("name", F.concat(safe_name(F.col("title")), F.when(F.col("many"), F.concat(F.lit(" - Tap "), F.col("volume").cast("string"))).otherwise(""), F.lit(".epub")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # a volume at a time: its lines take many times their bytes as Python objects
                own = batch.slice(i, 1)
                r = own.to_pylist()[0]
                made = build_epub(r, [(c["title"], c["lines"]) for c in r["chapters"]], r["volume"] if r["many"] else None)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in (book, "volume", "name")), pa.array([made], pa.binary())], names=[book, "volume", "name", "content"])

    return rows.mapInArrow(run, f"{book} {dict(books.dtypes)[book]}, volume int, name string, content binary")


def write_day(articles: DataFrame, path: str) -> None:
    """Articles by day, replacing only the days that are in them (SNK-04)."""
    articles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def digests(articles: DataFrame, names: DataFrame, order: list[Column]) -> DataFrame:
    """(day, category, name, text): a text of each category that has articles, under the category's name (SNK-04, JN-08)."""
    from pyspark.sql import Window

    block = F.concat_ws("\n", F.concat(F.lit("* "), F.col("title")), F.nullif("summary", F.lit("")), F.nullif("link", F.lit("")))
    placed = articles.withColumn("at_", F.row_number().over(Window.partitionBy("day", "category").orderBy(*order)))
    parts = placed.groupBy("day", "category").agg(F.sort_array(F.collect_list(F.struct("at_", block.alias("b")))).alias("parts"))
    named = parts.join(names, "category", "left").withColumn("name", F.coalesce("name", "category"))
    return named.select("day", "category", "name", F.concat("name", F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["b"]), "\n\n")).alias("text"))


def drop_day(spark, path: str, day: str) -> None:
    """Delete one day's partition; the day must be a date (SNK-09)."""
    import re

    from scriptorium.session import remove

    if not re.fullmatch(r"\d{4}-\d\d-\d\d", day):
        raise ValueError(f"not a day: {day!r}")
    remove(spark, f"{path.rstrip('/')}/day={day}")
