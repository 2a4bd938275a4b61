"""Smaller rules of libraries, lists and translations."""

from pyspark.sql import functions as F

from scriptorium.operators import library as lb


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_listings(spark):
    books = spark.createDataFrame([("a", 0, 5), ("b", 9, 1), ("c", None, 7)], "id string, read_at int, added int")
    assert [r["id"] for r in lb.by_last_read(books).collect()] == ["b", "c", "a"]
    files = spark.createDataFrame([("b", False, True), ("B", True, True), ("a", True, False)], "name string, readable boolean, selected boolean")
    assert [r["name"] for r in lb.readable_first(files).collect()] == ["a", "B", "b"]
    assert tuple(lb.selection_counts(files).first()) == (2, 1)
    chapters = spark.createDataFrame([("k", 1, "Một"), ("k", 2, "Hai 1"), ("k", 3, "Ba")], "book_id string, idx int, title string")
    assert [r["idx"] for r in lb.chapters_like(chapters, "1").orderBy("idx").collect()] == [1, 2]
    assert [r["idx"] for r in lb.in_range(chapters, 0, 99).orderBy("idx").collect()] == [1, 2, 3]
    assert [r["idx"] for r in lb.in_range(chapters, 2, None).orderBy("idx").collect()] == [2, 3]
    assert tuple(lb.stored_counts(chapters).first()) == ("k", 3, 3)
    failures = spark.createDataFrame([("k", 2)], "book_id string, idx int")
    assert lb.failed_again(chapters, failures).count() == 1 and lb.next_page(chapters.withColumnRenamed("title", "url"), spark.createDataFrame([("Ba",), ("new",)], "url string")).count() == 1
    fetch, drifted = lb.refresh(chapters.where("idx < 3"), chapters.withColumn("title", F.when(F.col("idx") == 2, "x").otherwise(F.col("title"))))
    assert [r["idx"] for r in fetch.collect()] == [3] and drifted.count() == 1
    feeds = spark.createDataFrame([("A", "vn", "u", False), ("ab", "vn", "", False), ("b", "us", "u", True)], "name string, country string, url string, disabled boolean")
    found, counts = lb.feeds_like(feeds, "vn", "a")
    assert found.count() == 2 and tuple(counts.first()) == (2, 2) and lb.usable_feeds(feeds).count() == 1
    slugs = spark.createDataFrame([("s", 0, "", "c1"), ("t", 1, "", ""), ("s", 2, "N", "c2")], "slug string, pos int, name string, cover string")
    assert [tuple(r) for r in lb.merge_slugs(slugs).collect()] == [("s", 0, "N", "c1")]
    turns = spark.createDataFrame([("s", 1), ("t", 5), ("s", 3)], "session_id string, at int")
    assert [tuple(r) for r in lb.sessions(turns).collect()] == [("t", 1, 5), ("s", 2, 3)]
    articles = spark.createDataFrame([("d1", "a"), ("d2", "a"), ("d2", "b"), ("d2", "a")], "day string, category string")
    assert [(r["day"], r["n"], r["by_category"]) for r in lb.days(articles).collect()] == [("d2", 3, {"a": 2, "b": 1}), ("d1", 1, {"a": 1})]


def test_titles_and_pages(spark):
    cut = lambda t: value(spark, lb.title_without_book(F.lit(t), F.lit("Sách (1)")))
    assert cut("SÁCH (1) - Chương 1") == "Chương 1" and cut("Sách (1) khác") == "Sách (1) khác" and cut("Chương") == "Chương"
    assert value(spark, lb.locked(F.lit("x"))) is True
    embed = lambda a, b: value(spark, lb.may_embed(F.lit(a), F.lit(b)))
    assert [embed(None, None), embed("DENY", None), embed("", "frame-ancestors 'self'; x"), embed("", "frame-ancestors *")] == [True, False, False, True]
    assert value(spark, lb.repair(F.lit('<div>anh ch*t <a href="x">q</a> &nbsp;ƣ h . a . i</div>'))) == "anh chết ư hai"


def test_links(spark):
    links = spark.createDataFrame([("http://a/truyen/x-y/",), ("http://b/z",), ("http://c",)], "link string")
    patterns = spark.createDataFrame([("p", "a/truyen", 2, False), ("q", "^http://a", 1, True), ("r", "http", 3, False)], "source string, pattern string, ord int, disabled boolean")
    assert {r["link"][7]: r["source"] for r in lb.first_match(links, patterns).collect()} == {"a": "p", "b": "r", "c": "r"}
    books = spark.createDataFrame([("http://c", "q"), ("http://other", "x-y")], "url string, slug string")
    assert sorted(r["link"] for r in lb.owned(links, books).collect()) == ["http://a/truyen/x-y/", "http://c"]


def test_translations(spark):
    assert value(spark, lb.needs_translation(F.lit("en"), "vi")) is True and value(spark, lb.same_language(F.lit("VI-vn"), "vi")) is True
    assert value(spark, lb.displayed(F.lit("o"), F.lit("t"), F.lit("vi"), "vi")) == "t" and value(spark, lb.displayed(F.lit("o"), F.lit("t"), F.lit("en"), "vi")) == "o"
    texts = spark.createDataFrame([("ABCDX",), ("",), ("zz",)], "text string")
    words = spark.createDataFrame([("A", "1"), ("AB", "2"), ("BCD", "3"), ("CD", "4")], "term string, value string")
    assert {r["text"]: r["draft"] for r in lb.segment_translate(texts, words).collect()} == {"ABCDX": "24X", "": "", "zz": "zz"}


def test_import(spark, tmp_path):
    from scriptorium.sinks.writers import text_files
    from scriptorium.sources.readers import parse_files

    body = "\n".join(f"Chapter {i}\nfooter\ntext {i}\n***" for i in range(1, 6)) + "\nChapter 6\nfooter\n***"
    works = parse_files(spark.createDataFrame([("w.txt", bytearray(body.encode()))], "name string, content binary"))
    books, chapters = lb.import_works(works)
    assert [(r["idx"], r["title"], r["lines"]) for r in chapters.orderBy("idx").collect()] == [(i, f"Chapter {i}", [f"text {i}"]) for i in range(1, 6)]
    assert books.first()["url"].startswith("local:") and "footer" not in text_files(books, chapters).first()["text"]
    lb.write_cache(chapters, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 5


def test_import_once(spark):
    """a line is normalised and tidied once, and only books of four or more chapters are looked through for repeated lines."""
    rows = [("a", "t", "", [("c", ["e\u0301 \t x ", None, "", "***", "foot"])] * 3), ("b", "t", "", [(f"c{i}", [f"l{i}", "foot"]) for i in range(4)]), (None, "t", "", [("c", ["foot"])] * 4)]
    works = spark.createDataFrame(rows, "name string, title string, author string, chapters array<struct<title: string, lines: array<string>>>")
    _, chapters = lb.import_works(works)
    plan = chapters._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("regexp_replace(regexp_replace(") == 1
    got = {(r["book_id"], r["idx"]): r["lines"] for r in chapters.collect()}
    assert got == {("a", i): ["\u00e9 x", "foot"] for i in (1, 2, 3)} | {("b", i + 1): [f"l{i}"] for i in range(4)} | {(None, i): ["foot"] for i in (1, 2, 3, 4)}


def test_settings():
    got = lb.settings({"threads": 99, "delay": -1, "ai": {"model": "m"}, "own": 1})
    assert (got["threads"], got["delay"], got["own"], got["ai"]) == (32, 0, 1, {"max_tokens": 3000, "model": "m"})
