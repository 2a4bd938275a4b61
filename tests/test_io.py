"""Readers, sinks, feeds, registry and streams: exact round trips."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.sinks import writers
from scriptorium.sources import feeds, readers, registry


@pytest.mark.parametrize(("text", "encoding"), [("Đường xa", "utf-8"), ("Đường xa", "utf-8-sig"), ("Đường xa", "utf-16"), ("中文字符", "gb18030")])
def test_decode(text, encoding):
    assert readers.decode(text.encode(encoding)) == text


def test_decode_never_fails():
    assert readers.decode(bytes(range(128, 256)))
    assert readers.decode("é".encode()) == "é"


BOOK = {"title": "Tên & Sách", "author": "Ai <đó>", "description": "D", "url": "http://h", "cover": b"x" * 300, "cover_ext": "jpg"}
CHAPTERS = [("Chương 1", ["a & b", "c"]), ("Chương 2", ["d"])]


def test_epub_round_trip():
    data = writers.build_epub(BOOK, CHAPTERS)
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    got = readers.read_one("x.epub", data)
    assert got["error"] is None and (got["title"], got["author"], got["cover"]) == ("Tên & Sách", "Ai <đó>", b"x" * 300)
    assert [(c["title"], c["lines"]) for c in got["chapters"]][1:] == CHAPTERS
    assert data == writers.build_epub(BOOK, CHAPTERS)


def docx(paragraphs) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>" for style, text in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx():
    got = readers.read_one("d.docx", docx([("Heading1", "Book"), ("Heading2", "C1"), ("", "a"), ("Heading2", "C2"), ("", "b")]))
    assert got["title"] == "Book" and [(c["title"], c["lines"]) for c in got["chapters"]] == [("C1", ["a"]), ("C2", ["b"])]


def test_markdown_and_html():
    got = readers.read_one("m.md", b"# Book\n## One\ntext [l](u)\n```\n# code\n```\n## Two\n![i](j) t")
    assert got["title"] == "Book" and [(c["title"], c["lines"]) for c in got["chapters"]] == [("One", ["text l", "# code"]), ("Two", ["i t"])]
    got = readers.read_one("p.html", b"<head><title>T</title></head><p>a</p>")
    assert got["title"] == "T" and got["chapters"] == [{"title": "T", "lines": ["a"]}]


def test_quarantine(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"Chapter 1\nx\nChapter 2\ny")), ("b.doc", bytearray(b"")), ("c.epub", bytearray(b"no zip")), ("d.txt", bytearray(b"")), ("e", None)], "name string, content binary")
    good, bad = readers.split_quarantine(readers.parse_files(files).cache())
    assert [r["name"] for r in good.collect()] == ["a.txt"] and sorted(r["name"] for r in bad.collect()) == ["b.doc", "c.epub", "d.txt", "e"]
    assert [(r["idx"], r["title"], r["lines"]) for r in readers.chapters_of(good).orderBy("idx").collect()] == [(1, "Chapter 1", ["x"]), (2, "Chapter 2", ["y"])]


def test_files_and_cache(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "A b.txt").write_text("Chapter 1\nx\nChapter 2\ny", encoding="utf-8")
    assert readers.read_works(spark, str(tmp_path / "w")).first()["title"] == "A b"
    folder = tmp_path / "lib" / "book"
    folder.mkdir(parents=True)
    for name, text in {"00002.txt": "Two\nsome longer body text", "00001.txt": "One\nsome longer body text\nmore", "x.txt": "not a chapter at all, really", "00003.txt": "tiny"}.items():
        (folder / name).write_text(text, encoding="utf-8")
    got = readers.read_cache(spark, str(folder)).orderBy("idx").collect()
    assert [(r["idx"], r["title"], r["text"]) for r in got] == [(1, "One", "some longer body text\nmore"), (2, "Two", "some longer body text")]
    spark.dataSource.register(registry.ChapterSource)
    rows = spark.read.format("chapters").option("path", str(tmp_path / "lib")).load().orderBy("idx").collect()
    assert [(r["book_id"], r["idx"], r["title"]) for r in rows] == [("book", 1, "One"), ("book", 2, "Two"), ("book", 3, "tiny")]


def test_text_files(spark):
    books = spark.createDataFrame([("b", "T:1", "me", "")], "book_id string, title string, author string, url string")
    rows = spark.createDataFrame([("b", i, f"C{i}", ["x", "y"]) for i in (1, 2, 3)], "book_id string, idx int, title string, lines array<string>")
    got = writers.text_files(books, rows, size=2).orderBy("volume").collect()
    assert [r["name"] for r in got] == ["T1 - Tap 1.txt", "T1 - Tap 2.txt"]
    assert got[1]["text"] == "T:1\nTac gia: me\n" + "=" * 60 + "\n\n\nC3\n" + "-" * 40 + "\nx\ny"
    assert writers.epub_files(books, rows, size=2).count() == 2


def test_days(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.createDataFrame([("2024-01-01", "the-thao", "A", "s", "l"), ("2024-01-02", "y-te", "B", "", "")], "day string, category string, title string, summary string, link string").withColumn("day", F.to_date("day"))
    writers.write_day(rows, path)
    writers.write_day(rows.where("category = 'y-te'").withColumn("title", F.lit("B2")), path)
    assert sorted(r["title"] for r in spark.read.parquet(path).collect()) == ["A", "B2"]
    names = spark.createDataFrame([("the-thao", "Thể thao")], "category string, name string")
    text = {r["category"]: r["text"] for r in writers.digests(rows, names, [F.col("title")]).collect()}
    assert text == {"the-thao": "Thể thao\n\n* A\ns\nl", "y-te": "y-te\n\n* B"}
    writers.drop_day(spark, path, "2024-01-02")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        writers.drop_day(spark, path, "../x")


RSS = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:media="http://search.yahoo.com/mrss/"><channel>
<item><title>A &amp; b</title><guid>http://h/sport/1</guid><description>&lt;p&gt;A summary that is long enough.&lt;/p&gt; Read more</description><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate><media:thumbnail url="http://h/i.jpg"/></item>
<item><title> </title></item><item><title>C</title><link>http://h/2</link><description>short</description><content:encoded>{long}</content:encoded></item></channel></rss>"""


def test_feed(spark):
    xml = RSS.replace("{long}", "&lt;p&gt;" + "w " * 300 + "&lt;/p&gt;")
    rows = spark.createDataFrame([("f", "Feed", "vn", "vi", "", xml), ("g", "Bad", "us", "en", "", "<rss"), ("h", "Atom", "us", "en", "y-te", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="http://a/1"/><updated>2024-03-01T00:00:00Z</updated></entry></feed>')], "id string, name string, country string, lang string, category string, xml string")
    got = {r["title"]: r for r in feeds.articles(rows).collect()}
    assert set(got) == {"A & b", "C", "E"}
    assert (got["A & b"]["link"], got["A & b"]["summary"], got["A & b"]["image"], got["A & b"]["category"]) == ("http://h/sport/1", "A summary that is long enough", "http://h/i.jpg", "the-thao")
    assert got["C"]["body"].startswith("<p>w w") and got["E"]["category"] == "y-te" and got["E"]["link"] == "http://a/1"
    probes = feeds.probe(rows, F.to_timestamp(F.lit("2024-03-01 12:00:00")))
    assert {r["id"]: (r["items"], r["age_hours"], r["alive"]) for r in probes.collect()}["f"] == (3, 2.0, True)
    assert {r["country"]: (r["alive"], r["dead"]) for r in feeds.health(probes).collect()} == {"vn": (1, 0), "us": (0, 2)}


def test_registry(spark):
    r = registry.Registry()
    r.add(registry.Source("generic", "Any", priority=999))
    r.add(registry.Source("blh", "B", ["serial.example"], 10, {"search": None}))
    assert r.for_url("http://www.serial.example/x").id == "blh" and r.for_url("http://notserial.example/").id == "generic"
    assert [s.id for s in r.all()] == ["blh", "generic"] and [s.id for s in r.searchable()] == ["blh"] and r.by_id("x") is None
    assert r.table(spark).count() == 2
    pages = spark.createDataFrame([("b", 1, '[{"title":"A","url":"u1","vip":true},{"title":"","url":""}]'), ("b", 2, '[{"title":"A again","url":"u1"},{"title":"B","url":"u2"}]')], "book_id string, page int, json string")
    assert [(c["idx"], c["title"], c["vip"]) for c in registry.chapter_list(pages).orderBy("idx").collect()] == [(1, "A", True), (2, "B", False)]


def test_streams(spark, tmp_path):
    from scriptorium.streaming import news as sn

    src = str(tmp_path / "in")
    schema = "day date, key string, summary string, at long, source string"
    write = lambda rows: spark.createDataFrame(rows, "d string, key string, summary string, at long, source string").select(F.to_date("d").alias("day"), "key", "summary", "at", "source").write.mode("append").parquet(src)
    out, cp = str(tmp_path / "days"), str(tmp_path / "cp")
    for batch in ([("2024-01-01", "k", "ab", 1, "s1"), ("2024-01-02", "j", "x", 1, "s1")], [("2024-01-01", "k", "abcd", 2, "s2"), ("2024-01-01", "k", "a", 3, "s3")]):
        write(batch)
        stream = spark.readStream.schema(schema).parquet(src)
        sn.upsert_days(stream, out, "key", "summary", "at", "source", cp).start().awaitTermination()
    assert sorted((r["key"], r["summary"]) for r in spark.read.parquet(out).collect()) == [("j", "x"), ("k", "abcd")]
    dated, undated = sn.dated(spark.createDataFrame([(None,), (1,)], "ts int"))
    assert dated.count() == undated.count() == 1


def test_session_stream(spark, tmp_path):
    from scriptorium.streaming.news import session_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("s", 1, '{"manh_moi_moi": ["một lời hứa lớn"]}'), ("s", 2, "{}"), ("t", 1, "bad")], "session_id string, turn int, state string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("session_id string, turn int, state string").parquet(src)
    q = session_stream(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("s", 2, 1), ("t", 1, 0)]


def test_works_are_given_out_as_they_are_read():
    import pandas as pd

    from scriptorium.sources import readers

    files = pd.DataFrame({"name": [f"{i}.txt" for i in range(40)], "content": [b"line\n" * 50_000] * 39 + [None]})
    found = list(readers.works_of(iter([files])))
    assert len(found) == 8 and sum(map(len, found)) == 40 and max(map(len, found)) == 5
    assert [n for x in found for n in x["name"]] == list(files["name"])
