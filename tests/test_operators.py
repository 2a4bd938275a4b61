"""Golden cases and properties of the operators."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import batching, catalog, cleaning, news, segment, session


def line_rows(spark, lines, doc="d"):
    return spark.createDataFrame([(doc, i, x) for i, x in enumerate(lines)], "doc string, pos int, line string")


def cleaned(spark, lines, rules=None):
    rows = cleaning.clean(line_rows(spark, lines), ["doc"], rules).orderBy("pos").collect()
    return [r["line"] for r in rows]


def test_repeat_after_decoration(spark):
    assert cleaned(spark, ["A", "***", "A", "B"]) == ["A", "B"]


def test_rules(spark):
    rules = cleaning.Rules(remove=["[x]"], drop_line=["^spam", "("], regex=[(r"(\w+)@(\w+)", r"\2 at \1"), ("[", "")], names={"Lý": "Ly"})
    assert cleaned(spark, ["[x]Lý  đi", "SPAM here", "Joe@home $1", "é"], rules) == ["Ly đi", "home at Joe $1", "é"]


@pytest.mark.parametrize(("n", "need"), [(3, None), (4, 3), (5, 3), (6, 3), (10, 6), (50, 30)])
def test_boilerplate_threshold(spark, n, need):
    for hits in ([] if need is None else [need - 1, need]) or [n]:
        rows = [("b", c, line) for c in range(n) for line in (["foot", "foot"] if c < hits else []) + [f"own {c}"]]
        got = cleaning.detect_boilerplate(spark.createDataFrame(rows, "book string, chapter int, line string"), "book", "chapter")
        assert [r["line"] for r in got.collect()] == (["foot"] if need is not None and hits >= need else [])


@pytest.mark.parametrize(("n", "step", "size"), [(4, 1, 4), (15, 1, 15), (31, 2, 15), (50, 3, 15)])
def test_systematic_sample(spark, n, step, size):
    rows = spark.createDataFrame([("b", i) for i in range(n)], "book string, chapter int")
    got = sorted(r["chapter"] for r in cleaning.systematic_sample(rows, "book", "chapter").collect())
    assert got == list(range(0, n, step))[:size] and len(got) == size


def batches_of(spark, sizes, rule):
    rows = spark.createDataFrame([("b", i, s) for i, s in enumerate(sizes)], "book string, i int, size long")
    got = batching.batches(rows, "book", "i", "size", rule).orderBy("i").collect()
    out: dict = {}
    for r in got:
        out.setdefault(r["batch"], []).append(sizes[r["i"]])
    return [out[k] for k in sorted(out)]


def test_batches(spark):
    sizes = [3, 4, 5, 1, 9, 2]
    assert batches_of(spark, sizes, lambda s: batching.overshoot(s, 6)) == [[3, 4], [5, 1], [9], [2]]
    assert batches_of(spark, sizes, lambda s: batching.within(s, 6)) == [[3], [4], [5, 1], [9], [2]]
    assert [len(x) for x in batches_of(spark, [100] * 10, batching.small)] == [8, 2]
    assert batches_of(spark, [700, 600, 1300, 10], batching.small) == [[700], [600], [1300], [10]]


@pytest.mark.parametrize("n", [1, 60, 61, 100, 125, 240])
def test_even_sample(spark, n):
    rows = spark.createDataFrame([("b", i) for i in range(n)], "book string, i int")
    want = [int(i * (n / 60)) for i in range(60)] if n > 60 else list(range(n))
    got = sorted(r["i"] for r in batching.even_sample(rows, "book", "i").collect())
    assert got == sorted(set(want))


def chapters(spark, lines, **more):
    rows = segment.split_chapters(line_rows(spark, lines), ["doc"], title="doc" if more.get("title") else None).orderBy("idx", "n").collect()
    out: dict = {}
    for r in rows:
        out.setdefault((r["idx"], r["title"]), []).append(r["line"])
    return [(t, x) for (_, t), x in out.items()]


def test_split_chapters(spark):
    from scriptorium.sources.readers import split_lines

    cases = [
        ["Chapter 1", "a", "Chapter 2", "------", "b"], ["Chapter 1", "a"], ["x", "y", "z", "Chương 1", "a", "", "Chương 2", "b"], ["x", "Hồi 1", "Hồi 2", "b"],
        ["Tên", "-------", "a", "Tên hai", "-------", "b"], ["第12章 x", "a", "第十三回", "b"], ["Chapter 1", "Chapter 2"],
    ]
    for lines in cases:
        assert chapters(spark, lines, title=True) == split_lines("\n".join(lines), "d"), lines
    assert chapters(spark, cases[0]) == [("Chapter 1", ["a"]), ("Chapter 2", ["b"])]


def test_split_fallback(spark):
    assert [len(x) for _, x in chapters(spark, ["x"] * 450)] == [450]
    assert [(t, len(x)) for t, x in chapters(spark, ["x"] * 451)] == [("Phần 1", 300), ("Phần 2", 151)]


def in_pieces(draw, n):
    """The same random texts of n books, each a list of rows, with a column that cuts them anywhere, null first."""
    import random

    r = random.Random(7)
    books = [[draw(r) for _ in range(r.randrange(1, 14))] for _ in range(n)]
    rows = []
    for b, items in enumerate(books):
        piece = None if b % 5 == 0 else 0
        for i, x in enumerate(items):
            piece = (piece or 0) + r.choice([0, 0, 1, 3]) if i and r.random() < 0.6 else piece
            rows.append((f"b{b}" if b else None, piece, i, *(x if isinstance(x, tuple) else (x,))))
    return books, rows


def by_book(found, n):
    out: dict = {f"b{b}" if b else None: {} for b in range(n)}
    for x in sorted(found.collect(), key=lambda x: (x["doc"] or "", x["idx"], x["n"])):
        out[x["doc"]].setdefault((x["idx"], x["title"]), []).append((x["n"], x["line"]))
    for chapters_ in out.values():
        assert [i for i, _ in chapters_] == list(range(1, len(chapters_) + 1)) and all([n for n, _ in x] == list(range(1, len(x) + 1)) for x in chapters_.values())
    return [[(t, [line for _, line in x]) for (_, t), x in chapters_.items()] for chapters_ in out.values()]


def test_split_chapters_in_pieces(spark):
    """F14, F16: what a piece's last line is, and where its lines stand, depends on other pieces."""
    from scriptorium.sources.readers import split_lines

    n = 400
    books, rows = in_pieces(lambda r: r.choice(["Chapter 1", "Chương 2", "-------", "-------", "Tên", "a", " ", "x" * 110, "第3章"]), n)
    lines = spark.createDataFrame(rows, "doc string, piece int, pos int, line string").withColumn("name", F.lit("t"))
    found = by_book(segment.split_chapters(lines, ["doc"], title="name", piece="piece"), n)
    assert found == by_book(segment.split_chapters(lines, ["doc"], title="name"), n)
    for items, x in zip(books, found, strict=True):
        if any(i.strip() for i in items):
            assert x == split_lines("\n".join(items), "t"), items
    long = spark.range(1000).select(F.lit("d").alias("doc"), F.floor(F.col("id") / 7).alias("piece"), F.col("id").alias("pos"), F.lit("x").alias("line"))
    assert [(t, len(x)) for t, x in by_book(segment.split_chapters(long.withColumn("doc", F.lit(None).cast("string")), ["doc"], piece="piece"), 1)[0]] == [("Phần 1", 300), ("Phần 2", 300), ("Phần 3", 300), ("Phần 4", 100)]


def test_levels_in_pieces(spark):
    """chapters, prefixes, the opening and fences go on from piece to piece."""
    from scriptorium.sources.readers import assemble

    n = 400
    books, rows = in_pieces(lambda r: r.choice([(1, "P"), (2, "C"), (2, "D"), (3, "deep"), (None, "x"), (None, "y" * 60)]), n)
    items = spark.createDataFrame(rows, "doc string, piece int, pos int, level int, text string")
    found = by_book(segment.assemble_levels(items, ["doc"], piece="piece"), n)
    assert found == by_book(segment.assemble_levels(items, ["doc"]), n)
    for levels, x in zip(books, found, strict=True):
        assert x == assemble(levels), levels
    _, rows = in_pieces(lambda r: r.choice(["```", "# head", " ```py", "text", ""]), n)
    lines = spark.createDataFrame(rows, "doc string, piece int, pos int, line string")
    key = ["doc", "pos", "level", "text"]
    assert sorted(map(str, segment.markdown_items(lines, ["doc"], piece="piece").select(key).collect())) == sorted(map(str, segment.markdown_items(lines, ["doc"]).select(key).collect()))


def test_books_in_tasks(spark, data):
    """F12, F14, F16: no window runs over the lines, or the texts, of a whole book."""
    from scriptorium.plans import catalogue

    for name in ("heading_levels", "split_chapters", "split_fallback"):
        assert "windowspecdefinition(source#" not in catalogue.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(source#" not in catalogue._book_lines(spark, data, F.col("text"))._jdf.queryExecution().optimizedPlan().toString()


LEVELS = [(1, "P1"), (2, "C1"), (None, "x"), (2, "C2"), (None, "y"), (1, "P2"), (2, "C3"), (None, "z")]


def test_levels(spark):
    from scriptorium.sources.readers import assemble, commonest_level

    assert commonest_level([1, 2, 2, 2, 1, 2]) == 2 and commonest_level([1, 1, 2, 2]) == 2
    cases = [LEVELS, [(None, "intro " * 30), *LEVELS], [(None, "short"), *LEVELS, (3, "deep"), (None, "w")], [(1, "a")], [(1, "P"), (None, "a"), (None, "b"), (None, "c"), (2, "C"), (None, "d"), (2, "D"), (None, "e")]]
    for items in cases:
        rows = spark.createDataFrame([("d", i, lv, t) for i, (lv, t) in enumerate(items)], "doc string, pos int, level int, text string")
        out: dict = {}
        for r in segment.assemble_levels(rows, ["doc"]).orderBy("idx", "n").collect():
            out.setdefault((r["idx"], r["title"]), []).append(r["line"])
        assert [(t, x) for (_, t), x in out.items()] == assemble(items), items
    assert assemble(LEVELS) == [("P1 · C1", ["x"]), ("P1 · C2", ["y"]), ("P2 · C3", ["z"])]


def test_lift_title(spark):
    rows = spark.createDataFrame([("a", 0, 1, "Book"), ("a", 1, 2, "C"), ("b", 0, 1, "C1"), ("b", 1, 1, "C2"), ("c", 0, None, "x")], "doc string, pos int, level int, text string")
    titles, rest = segment.lift_title(rows, ["doc"])
    assert [(r["doc"], r["title"]) for r in titles.collect()] == [("a", "Book")] and rest.count() == 4


def test_bookmarks(spark):
    marks = spark.createDataFrame([("d", 0, 1, "P", 1), ("d", 1, 2, "A", 3), ("d", 2, 2, "B", 2), ("d", 3, 2, "C", 7)], "doc string, pos int, level int, title string, page int")
    got = segment.bookmark_ranges(marks, spark.createDataFrame([("d", 9)], "doc string, n int"), ["doc"]).orderBy("idx").collect()
    assert [(r["title"], r["first"], r["last"]) for r in got] == [("P · A", 2, 3), ("P · B", 2, 6), ("P · C", 6, 9)]


def test_title_lines(spark):
    rows = line_rows(spark, ["T", " T ", "a", "T"]).withColumn("title", F.lit("T"))
    assert [r["line"] for r in cleaning.drop_title_lines(rows, ["doc"]).orderBy("pos").collect()] == ["a", "T"]


@pytest.mark.parametrize(("lines", "want"), [(["x" * 60, "y" * 59], False), (["x" * 60, "y" * 60], True), (["a", "b", "c"], True)])
def test_opening(spark, lines, want):
    assert spark.createDataFrame([(lines,)], "l array<string>").select(cleaning.worth_keeping(F.col("l")).alias("x")).first()["x"] is want


def test_longest_first(spark):
    rows = spark.createDataFrame([("k", "aaaaa", 0, "s0"), ("k", "bbbbbbbbb", 1, "s1"), ("k", "ccccccccc", 2, "s2")], "key string, summary string, at int, source string")
    r = news.longest_first(rows, "key", F.length("summary"), "at", "source").first()
    assert r["summary"][0] == "b" and r["also_carried_by"] == ["s0", "s2"]


def test_merge_day(spark):
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    schema = "dedup_key string, published_at timestamp, translation string"
    at = lambda s: __import__("datetime").datetime.fromisoformat(s)
    fresh = spark.createDataFrame([("k1", at("2024-01-09"), None), ("k3", None, None), ("k4", at("2024-01-07"), None), ("k5", at("2024-01-08T01:00"), None)], schema)
    stored = spark.createDataFrame([("k1", at("2024-01-01"), "tr"), ("k2", at("2024-01-01"), "t2"), ("k4", at("2024-01-07"), "t4")], schema)
    got = {r["dedup_key"]: r["translation"] for r in news.merge_day(fresh, stored, now).collect()}
    assert got == {"k1": "tr", "k2": "t2", "k3": None, "k5": None}


def categorise(spark, title, summary="", link="", tags=(), hint=None):
    row = spark.createDataFrame([(title, summary, link, list(tags), hint)], "t string, s string, l string, g array<string>, h string")
    return row.select(news.category(F.col("t"), F.col("s"), F.col("l"), F.col("g"), F.col("h")).alias("x")).first()["x"]


def test_category(spark):
    assert categorise(spark, "x", hint="y-te") == "y-te"
    assert categorise(spark, "x", link="http://a/The-Thao/b") == "the-thao"
    assert categorise(spark, "x", tags=["Military", "sport"]) == "quan-su"
    assert categorise(spark, "x", tags=["other", "sport"]) == "thoi-su"
    assert categorise(spark, "The election vote") == "chinh-tri"
    assert categorise(spark, "x", summary="one bank") == "thoi-su"
    assert categorise(spark, "x", summary="bank and market") == "kinh-te"
    assert categorise(spark, "Quân đội") == "thoi-su"  # the stroke of the letter stays, so the phrase isn't met
    assert categorise(spark, "首相の選挙") == "chinh-tri"
    assert categorise(spark, "embankment") == "thoi-su"


def test_summary(spark):
    s = lambda x, t="Title": spark.range(1).select(news.summary(F.lit(x), F.lit(t)).alias("x")).first()["x"]
    assert s("A long enough text here. Read more...") == "A long enough text here"[: len("A long enough text here")]
    assert s("short") == "" and s("The same long title", "the SAME long title!") == ""


def test_route(spark):
    sources = spark.createDataFrame([("blh", "serial.example", 10), ("sub", "m.serial.example", 5), ("generic", None, 999)], "source string, domain string, priority int")
    urls = spark.createDataFrame([("http://www.serial.example/x",), ("http://m.serial.example/",), ("http://notserial.example/",), ("",)], "url string")
    got = {r["url"]: r["source"] for r in catalog.route(urls, sources).collect()}
    assert got == {"http://www.serial.example/x": "blh", "http://m.serial.example/": "sub", "http://notserial.example/": "generic", "": "generic"}


def test_crawl(spark):
    edges = [
        ("http://a/", "/p1", "next", 0), ("http://a/", "http://b/f.pdf", "file", 1), ("http://a/", "#x", "no", 2), ("http://a/", "http://b/away", "other host", 3), ("http://a/", "/p2#top", "next", 4),
        ("http://a/p1", "/deep", "more", 0), ("http://a/p1", "page.html", "kept as a file", 1), ("http://a/p2", "/", "home", 0), ("http://a/deep", "x.epub", "too deep", 0), ("http://a/p2", "/get", "Tải xuống", 1),
    ]
    pages, files = catalog.crawl(spark.createDataFrame(edges, "from_url string, href string, anchor string, pos int"), spark.createDataFrame([("http://a/#s", 0), ("ftp://x", 1)], "url string, ord int"), depth=1)
    assert [(r["url"], r["depth"]) for r in pages.orderBy("ord").collect()] == [("http://a/", 0), ("http://a/p1", 1), ("http://a/p2", 1)]
    assert {r["url"]: r["readable"] for r in files.collect()} == {"http://b/f.pdf": True, "http://a/page.html": True}
    pages, _ = catalog.crawl(spark.createDataFrame(edges, "from_url string, href string, anchor string, pos int"), spark.createDataFrame([("http://a/", 0)], "url string, ord int"), depth=3, max_pages=2)
    assert pages.count() == 2


def test_fuzzy_threads(spark):
    a = spark.createDataFrame([(1, "Nợ Lý Tam mười lượng bạc"), (2, "hẹn gặp ở bến sông")], "i int, t string")
    b = spark.createDataFrame([(7, "trả nợ mười lượng bạc cho Lý Tam")], "j int, r string")
    assert [(r["i"], r["j"]) for r in session.fuzzy_pairs(a, b, "i", "t", "j", "r").collect()] == [(1, 7)]


def test_not_contained(spark):
    fresh = spark.createDataFrame([("Lời hứa với Lý Tam",), ("một hẹn ước mới",), ("ba",), ("zz",)], "t string")
    known = spark.createDataFrame([("[Chương 2] lời hứa với lý tam ở ba bến",)], "k string")
    assert sorted(r["t"] for r in session.not_contained(fresh, known, "t", "k").collect()) == ["một hẹn ước mới", "zz"]


def test_session_state(spark):
    import json

    turns = [{"vi_tri": "A", "manh_moi_moi": ["nợ Lý Tam mười lượng bạc"], "bien_dong_the_gioi": ["x"]}, {"vi_tri": " ", "vat_pham": [{"a": "kiếm", "b": "cũ"}], "manh_moi_xong": ["trả nợ mười lượng bạc Lý Tam"]}]
    rows = spark.createDataFrame([("s", i, json.dumps(t)) for i, t in enumerate(turns)] + [("s", 9, "no json")], "session_id string, turn int, state string")
    state = json.loads(session.session_state(rows).first()["state"])
    assert state == {"vi_tri": "A", "vat_pham": ["kiếm — cũ"], "threads": [], "changes": ["[Chương 1] x"]}


def test_registries(spark):
    w = spark.createDataFrame([(["http://a/", "http://b/"], ["u1"])], "addresses array<string>, seen array<string>")
    more = spark.createDataFrame([(["http://a/", "http://b/"], ["u0", "u1"]), (["http://c/"], [])], "addresses array<string>, seen array<string>")
    got = catalog.upsert_watches(w, more).collect()
    assert sorted(r["seen"] for r in got) == [[], ["u0", "u1"]]
    urls = spark.createDataFrame([("http://a/x",), ("http://a/private/x",), ("http://a/private/ok",), ("http://b/",)], "url string")
    rules = spark.createDataFrame([("http://a", "/private", False), ("http://a", "/private/ok", True)], "origin string, prefix string, allow boolean")
    assert sorted(r["url"] for r in catalog.robots_allow(urls, rules).collect()) == ["http://a/private/ok", "http://a/x", "http://b/"]


def test_map_reduce(spark):
    import pandas as pd

    from scriptorium.functions.udf import vectorised

    def upper(s: pd.Series) -> pd.Series:
        return s.str.upper()

    def squeeze(s: pd.Series) -> pd.Series:
        return s.str.replace("\n\n", "+")

    notes = spark.createDataFrame([("b", i, f"n{i}") for i in range(5)] + [("c", 0, "only")], "book string, batch long, text string")
    got = {r["book"]: r["text"] for r in session.map_reduce(notes, vectorised("string")(upper), vectorised("string")(squeeze), 5).collect()}
    assert got["c"] == "ONLY" and got["b"].split("+") == ["N0", "N1", "N2", "N3", "N4"]


def test_belongs_shuffles_no_pairs(spark):
    """Pairs are distinct as they are made: nothing is shuffled or made distinct above the join by host."""
    urls = spark.createDataFrame([("http://a/1",), ("http://a/1",), ("http://a/2",), ("http://b/1",), ("x",)], "url string")
    watches = spark.createDataFrame([("w", ["http://a/9", "http://a/8"], ["http://a/1", "http://b/1"], ["http://b/1", "x"]), ("v", [], ["http://a/2"], None), (None, ["http://b/3"], None, ["http://b/1"])], "watch_id string, addresses array<string>, harvested array<string>, seen array<string>")
    got = catalog.belongs(urls, watches)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("w", "http://a/1"), ("w", "http://a/2"), ("w", "http://b/1"), ("w", "x"), ("v", "http://a/2"), (None, "http://b/1")], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")


def test_fuzzy_pairs_by_blocks(spark, monkeypatch):
    """Common words make no rows: blocks are compared whole, and nothing is grouped by pair; several blocks a side give what one does."""
    rows = [(i, " ".join(f"w{(i * j * j) % (7 + i % 31)}" for j in range(1, 12 + i % 5))) for i in range(120)]
    a, b = spark.createDataFrame(rows[:70], "i int, t string"), spark.createDataFrame(rows[50:], "j long, r string")
    sets = {i: {w for w in t.split() if len(w) >= 2} for i, t in rows}
    want = sorted((i, j, n) for i in range(70) for j in range(50, 120) if (n := len(sets[i] & sets[j])) >= 2 and n / min(len(sets[i]), len(sets[j])) >= 0.5)
    for block in (4096, 9):
        monkeypatch.setattr(session, "BLOCK", block)
        got = session.fuzzy_pairs(a, b, "i", "t", "j", "r")
        assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert dict(got.dtypes) == {"i": "int", "j": "bigint", "shared": "bigint"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Cross" in plan


def test_fuzzy_pairs_by_rare_words(monkeypatch):
    """sets of either side that are the smaller ones, any limits and pieces give what all pairs do; few pairs of sets that share common words alone are looked at."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    sets = [[np.unique((r.pareto(0.5, r.integers(2, most)) * 5).astype(np.int64) % 3000) for _ in range(300)] for most in (40, 25)]
    sets = [[(100 * i, x) for i, x in enumerate(side) if len(x) >= 2] for side in sets]

    def found(least, share):
        packed = [next(session._packed(iter([pa.record_batch({"id": [i for i, _ in side], "k": [[f"w{w}" for w in x] for _, x in side]})]))).column(0) for side in sets]
        out = [x.to_pydict() for x in session._shared(least, share)([pa.RecordBatch.from_arrays(packed, names=["a", "b"])])]
        return sorted(x for o in out for x in zip(o["a_id"], o["b_id"], o["shared"]))

    for least, share in ((2, 0.5), (1, 0.3), (3, 1.0), (2, 0.0)):
        want = sorted((i, j, n) for i, x in sets[0] for j, y in sets[1] if (n := len(np.intersect1d(x, y))) >= least and n / min(len(x), len(y)) >= share)
        for dense, more, held in ((1024, 2, 1 << 17), (1, 0, 50), (7, 1, 3), (0, 9, 700)):
            for k, v in (("DENSE", dense), ("MORE", more), ("HELD", held)):
                monkeypatch.setattr(session, k, v)
            assert found(least, share) == want and len(want) > 100
    monkeypatch.undo()
    spread, looked = session._spread, []
    monkeypatch.setattr(session, "_spread", lambda first, n: looked.append(int(n.sum())) or spread(first, n))
    common, own = [f"c{i}" for i in range(10)], lambda i: [f"o{i}-{j}" for j in range(20)]
    sets = [[(i, common + own(i + k)) for i in range(300)] for k in (0, 200)]
    sets = [[(i, np.array([int.from_bytes(w.encode()) for w in x], dtype=object)) for i, x in side] for side in sets]
    assert found(2, 0.5) == [(i, i - 200, 30) for i in range(200, 300)] and sum(looked) < 300 * 300 / 4


def test_long_works_are_folded_in_stretches(spark):
    """Batches of 30,000 items: what was folded isn't copied for every item, and stretches don't show in the result."""
    import time

    def seconds(n):
        rows = spark.range(n).select(F.lit("w").alias("w"), F.col("id"), (F.col("id") * 7919 % 400).alias("size"))
        began = time.time()
        got = [r["batch"] for r in batching.batches(rows, "w", "id", "size", batching.small).orderBy("id").collect()]
        return time.time() - began, got

    took, got = seconds(30_000)
    total = count = batch = 0
    for i, own in enumerate(got):
        size = i * 7919 % 400
        if count and (count >= 8 or total + size >= 1200):
            total, count, batch = 0, 0, batch + 1
        total, count = total + size, count + 1
        assert own == batch
    assert len(got) == 30_000 and seconds(60_000)[0] < 3 * took + 2
