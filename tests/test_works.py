"""Dictionaries, slugs, limits, small files, readers' metadata, odd URLs, walks, prefixes and event time against plain programs."""

import io
import random
import threading
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import catalog, dictionary, library, session
from scriptorium.sinks import files
from scriptorium.sources import client, readers
from scriptorium.streaming import news

# ---------------------------------------------------------------- dictionaries


def draft_brute(text, entries):
    out, i, n = "", 0, 0
    while i < len(text):
        found = max((t for t in entries if t and text.startswith(t, i)), key=len, default=None)
        out, i, n = (out + entries[found], i + len(found), n + 1) if found else (out + text[i], i + 1, n)
    return out, n


def test_longest_entries():
    rng = random.Random(1)
    for _ in range(300):
        entries = {"".join(rng.choices("ab中国", k=rng.randint(0, 4))): rng.choice(["X", "", "yy"]) for _ in range(rng.randint(0, 8))}
        text = "".join(rng.choices("ab中国 c", k=rng.randint(0, 30)))
        m = dictionary.Matcher(entries)
        assert (m.draft(text), len(list(m.segments(text)))) == draft_brute(text, entries)


@pytest.mark.parametrize("limit", [dictionary.BROADCAST_BYTES, 0])
def test_drafts(spark, limit):
    entries = spark.createDataFrame([("中", "A"), ("中国", "B"), ("人", "C"), ("", "no"), ("x", None), ("人", "D")], "term string, value string")
    texts = spark.createDataFrame([(1, "中国人中x"), (2, ""), (3, None), (4, "國")], "i int, text string")
    got = {r["i"]: r for r in dictionary.drafted(texts, entries, broadcast_bytes=limit).collect()}
    assert [got[i]["draft"] for i in (1, 2, 3, 4)] == ["BCAx", "", None, "國"]
    if limit:
        assert [got[i]["covered"] for i in (1, 2, 3, 4)] == [1.0, 1.0, None, 0.0]
        assert [(s["start"], s["term"]) for s in got[1]["segments"]] == [(0, "中国"), (2, "人"), (3, "中")]


def test_translations(spark):
    @F.pandas_udf("string")
    def polish(text: pd.Series, draft: pd.Series, segments: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else {"好吗": "how are you", "坏吗": "坏"}.get(t, " ") for t in text])

    entries = spark.createDataFrame([("好", "good"), ("坏", "bad"), ("天", "day")], "term string, value string")
    texts = spark.createDataFrame([("好吗",), ("坏吗",), ("好天",), ("记得",), ("别吗",)], "text string")
    memory = texts.where("text = '记得'").select(F.md5(F.concat_ws("\0", F.lit("vi"), "text")).alias("key"), F.lit("remembered").alias("value"))
    rows = dictionary.translated(texts, entries, memory, "vi", polish)
    got = {r["text"]: (r["translation"], r["way"]) for r in rows.collect()}
    assert got == {"好吗": ("how are you", "polished"), "坏吗": ("bad吗", "draft"), "好天": ("goodday", "draft"), "记得": ("remembered", "memory"), "别吗": ("别吗", "draft")}
    assert [r["value"] for r in dictionary.learned(rows, "vi").collect()] == ["how are you"]
    assert {r["way"] for r in dictionary.translated(texts, entries.limit(0), memory.limit(0), "vi").collect()} == {"draft"}


# ---------------------------------------------------------------- slugs, limits, walks


def test_unique_slugs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a-2", "a-3", "a-2-2", "b", "", "a-02", "a-1", "b-99999999999"])) for i in range(60)]
    got = {r["i"]: r["slug"] for r in catalog.unique_slugs(spark.createDataFrame(rows, "i int, slug string"), "slug", "i").collect()}
    real, used, want = {s for _, s in rows}, set(), {}
    for i, s in rows:
        name, n = s, 2
        while name in used or (name != s and name in real):
            name, n = f"{s}-{n}", n + 1
        used.add(name)
        want[i] = name
    assert got == want and len(set(got.values())) == 60


def test_first_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.lit("body").alias("body"))
    first = catalog.first_rows(rows, ["g"], [F.desc("id")], 30, ["g", "id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange") and "body" not in plan
    assert first.count() == 90 and first.where("at = 1").agg(F.min("id")).first()[0] == 997


def test_long_walk(spark):
    """More levels than are read as one table, and a limit."""
    edges = [(f"http://h/list?page={i}", f"http://h/list?page={i + 1}") for i in range(30)] + [("http://h/list?page=3", "http://h/list?page=2#top"), ("http://h/list?page=4", "http://h/other")]
    e = spark.createDataFrame(edges, "from_url string, href string")
    starts = spark.createDataFrame([(1, "http://h/list?page=0"), (2, "http://h/list?page=25#x")], "work int, url string")
    got = catalog.walk_pages(e, starts, limit=20).groupBy("work").count().collect()
    assert {r["work"]: r["count"] for r in got} == {1: 20, 2: 6}


# ---------------------------------------------------------------- small files


def test_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a/state.json"
    assert files.read_json(spark, path, {"none": 1}) == {"none": 1}
    values = [{"n": i, "text": str(i) * 20_000} for i in (1, 2)]
    files.write_json(spark, path, values[0])
    stop, bad, seen = threading.Event(), [], set()

    def reads():
        import json

        while not stop.is_set():
            try:
                with open(f"{tmp_path}/a/state.json", encoding="utf-8") as f:
                    seen.add(json.load(f)["n"])
            except Exception as e:
                bad.append(e)

    reader = threading.Thread(target=reads)
    reader.start()
    for i in range(30):
        files.write_json(spark, path, values[i % 2])
    stop.set()
    reader.join()
    assert not bad and seen == {1, 2} and files.read_json(spark, path) == values[1]
    assert [p.name for p in (tmp_path / "a").iterdir() if p.name.endswith(".tmp")] == []
    # The other way, of file systems that rename over what is there.
    where, raw, conf = files._hadoop(spark, path)
    aside, _, _ = files._hadoop(spark, f"file://{tmp_path}/a/.aside")
    (tmp_path / "a" / ".aside").write_text("[1]")

    class Other:
        def getUri(self):
            return self

        def getScheme(self):
            return "other"

    files._replace(spark, aside, where, conf, Other())
    assert files.read_json(spark, path) == [1] and not (tmp_path / "a" / ".aside").exists()
    files.write_text(spark, path, "no json")
    assert files.read_json(spark, path, 7) == 7 and files.read_text(spark, path) == "no json"


def test_deletes_stay_within(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    files.write_text(spark, f"{root}/book/x.txt", "x")
    for parts in ((), ("",), ("..",), ("book", ".."), ("a/b",), (" ",), ("a\\b",)):
        with pytest.raises(ValueError, match="not under"):
            files.drop_within(spark, root, *parts)
    files.drop_within(spark, root, "book")
    assert (tmp_path / "root").is_dir() and not (tmp_path / "root" / "book").exists()


# ---------------------------------------------------------------- readers and clients


def docx(paragraphs, core=None):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>" for props, text in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        if core is not None:
            z.writestr("docProps/core.xml", core)
    return out.getvalue()


CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> The Book </dc:title><dc:creator>Ann</dc:creator></cp:coreProperties>'


def test_docx_metadata():
    heading = lambda n: f'<w:pStyle w:val="Heading{n}"/>'
    text = [(heading(1), "Part"), ("", "intro"), ('<w:outlineLvl w:val="1"/>', "One"), ("", "a  b"), (heading(2), "Two"), ("", "c"), ('<w:outlineLvl w:val="8"/>', "deep"), (heading(1), "x" * 151)]
    work = readers.read_docx("f.docx", docx(text, CORE))
    assert (work["title"], work["author"]) == ("The Book", "Ann")
    assert readers.read_docx("f.docx", docx(text))["author"] == ""
    assert readers.read_docx("My file.docx", docx([("", "just text")], "<broken"))["title"] == "My file"
    assert readers.read_docx("f.docx", docx(text, CORE.replace(" The Book ", " ")))["title"] != "The Book"
    assert [t for t, _ in work["chapters"]][-2:] != [] and any("deep" in x for _, lines in work["chapters"] for x in lines)
    with pytest.raises(ValueError, match="docx"):
        readers.read_docx("f.docx", b"no archive")
    row = readers.read_one("f.docx", docx(text, CORE))
    assert row["author"] == "Ann" and row["error"] is None


def test_odd_urls(spark):
    def get(url):
        if "bad" in url:
            raise ValueError(url)
        if "down" in url:
            raise OSError
        return 200, url.encode(), ""

    urls = ["http://[bad", "http://ok/a", "", None, "http://down/", "not a url", "http://h/bad"]
    got = {r["url"]: (r["status"], r["tries"]) for r in client.fetch(spark.createDataFrame([(u,) for u in urls], "url string"), get, retries=1, spacing=0, sleep=lambda s: None).collect()}
    assert got["http://[bad"] == (0, 1) and got["http://ok/a"] == (200, 1) and got["http://down/"] == (0, 2) and got["http://h/bad"] == (0, 1)
    assert set(got) == set(urls)


def test_merged_settings(spark):
    rows = spark.createDataFrame([('{"threads": 99, "ai": {"x": 1}}',), ("no json",), (None,), ('{"threads": "many"}',), ("[1]",)], "s string").select(library.merged_settings(F.col("s")).alias("m"))
    got = [__import__("json").loads(r["m"]) for r in rows.collect()]
    assert got[0]["threads"] == 32 and got[0]["ai"] == {"max_tokens": 3000, "x": 1} and all(g == library.settings({}) for g in got[1:])


# ---------------------------------------------------------------- threads


def test_prefixes_of_any_script(spark):
    rng = random.Random(9)
    known = ["".join(rng.choices("天地玄黄宇宙洪荒日月", k=600)) for _ in range(8)] + ["Ab cd", "hello there world", "x" * 700 + "yz", "", None]
    fresh = [k[i : i + rng.randint(1, 45)] for k in known[:8] for i in (0, 255, 300, 590)] + ["天天天天天天天", "", None, "AB C", "b c", "z", "yz", "q", "xxxyz", "lo there wor", "LO  there", "ere "]
    got = sorted(r["i"] for r in session.not_contained(spark.createDataFrame(list(enumerate(fresh)), "i int, t string"), spark.createDataFrame([(k,) for k in known], "k string"), "t", "k").collect())
    low = [k.lower() for k in known if k]
    assert got == [i for i, t in enumerate(fresh) if not any((t or "")[:40].lower() in k for k in low)]
    assert session.not_contained(spark.createDataFrame([(1, "a"), (2, "")], "i int, t string"), spark.createDataFrame([], "k string"), "t", "k").count() == 2


def test_fuzzy_pairs_brute(spark):
    rng = random.Random(5)
    words = [f"word{chr(97 + i)}" for i in range(14)]
    a = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(60)] + [(0, "worda wordb")]
    b = [(i, " ".join(rng.choices(words, k=rng.randint(0, 14)))) for i in range(60)]
    got = sorted(tuple(r) for r in session.fuzzy_pairs(spark.createDataFrame(a, "i int, t string"), spark.createDataFrame(b, "j int, r string"), "i", "t", "j", "r").collect())
    want = set()
    for i, t in a:
        for j, r in b:
            x, y = set(t.split()), set(r.split())
            if x and y and len(x & y) >= 2 and len(x & y) / min(len(x), len(y)) >= 0.5 and min(len(x), len(y)) >= 2:
                want.add((i, j, len(x & y), tuple(sorted(x))))
    assert got == sorted((i, j, n) for i, j, n, _ in want)


# ---------------------------------------------------------------- event time


def test_late_and_undated(spark, tmp_path):
    """Rows behind the watermark are left out, undated ones take their own way, and both are told apart side by side."""
    import datetime as dt

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    batches = [[(day(1), "a", 1), (day(1, 5), "a", 1), (None, "a", 1)], [(day(9), "a", 1)], [(day(2), "a", 1), (day(9, 1), "b", 2), (None, "b", 2)], [(day(20), "z", 9)]]
    schema = "ts timestamp, kind string, user int"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    runs = {"slide": lambda s: news.sliding_counts(s, "kind", size="1 day", step="12 hours", horizon="2 days"), "sessions": lambda s: news.sessions(s, "user", gap="6 hours", horizon="2 days")}
    for name, build in runs.items():
        for i in range(4):  # a run for each folder, so that batches come in this order
            dated, _ = news.dated(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/[0-{i}]"))
            build(dated).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/at-{name}").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/{name}").awaitTermination()
    slide = {(r["start"].day, r["start"].hour, r["kind"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/slide").collect()}
    assert slide[(1, 0, "a")] == 2 and slide[(9, 0, "a")] == 1 and slide[(9, 0, "b")] == 1
    assert not any(d == 2 for d, _, _ in slide)  # came a week late
    got = {(r["user"], r["start"].day): (r["end"].day, r["end"].hour, r["n"]) for r in spark.read.parquet(f"{tmp_path}/sessions").collect()}
    assert got[(1, 1)] == (1, 11, 2) and got[(1, 9)] == (9, 6, 1) and (1, 2) not in got
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    news.dated(stream)[1].writeStream.option("checkpointLocation", f"{tmp_path}/at-undated").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/undated").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/undated").count() == 2


def test_chapter_source(spark, tmp_path):
    from scriptorium.sources.registry import ChapterSource

    spark.dataSource.register(ChapterSource)
    for book, name, text in (("b k", "00002.txt", "Title\nbody\nmore"), ("b k", "1.txt", "\nx"), ("b k", "x.txt", "no"), ("a", "3.md", "no"), ("é#", "10.txt", "only")):
        (tmp_path / book).mkdir(exist_ok=True)
        (tmp_path / book / name).write_text(text, encoding="utf-8")
    for path in (str(tmp_path), tmp_path.as_uri()):
        got = sorted(tuple(r) for r in spark.read.format("chapters").option("path", path).load().collect())
        assert got == [("b k", 1, "Chương 1", "x"), ("b k", 2, "Title", "body\nmore"), ("é#", 10, "only", "")]
