"""Scalar functions against golden cases and plain-Python specifications."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("Bóng đá", "bong đa"), ("Élève ÇA", "eleve ca"), ("войск", "воиск"), ("ガイド", "カイト"), ("Straße", "straße")])
def test_fold(spark, text, want):
    assert one(spark, tx.fold(F.col("t")), t=text) == want
    assert tx.py_fold(text) == want


def test_fold_d(spark):
    assert one(spark, tx.fold(F.col("t"), fold_d=True), t="Đá") == "da"


def test_fold_matches_python(spark):
    chars = [chr(c) for c in range(0x20, 0x2000) if not 0x0E00 <= c < 0x1D00]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", tx.fold(F.col("c")).alias("f")).collect()
    wrong = [r["c"] for r in rows if r["f"] != tx.py_fold(r["c"]) and len(tx.py_fold(r["c"])) == 1 and r["c"] not in "İ"]
    assert not wrong


@pytest.mark.parametrize(("line", "want"), [("* * *", True), ("—", True), ("_" * 40, True), ("*" * 41, False), ("é", False), ("", True)])
def test_decor(spark, line, want):
    assert one(spark, tx.is_decor(F.col("t")), t=line) is want


@pytest.mark.parametrize(("url", "want"), [("https://A.com/x/?a=1#t", "https://a.com/x"), ("https://a.com/X", "https://a.com/x"), ("http://a.com/", "http://a.com"), ("", "bong đa")])
def test_dedup_key(spark, url, want):
    assert one(spark, tx.dedup_key(F.col("u"), F.lit("Bóng đá")), u=url) == want


def test_strip_takes_unicode_space(spark):
    assert one(spark, tx.collapse(F.col("t")), t=" a  b\t\n") == "a b"


@pytest.mark.parametrize(("text", "want"), [('text ```json {"a":1}``` tail', '{"a": 1}'), ('x {bad} {"b":2}', '{"b": 2}'), ("nothing", None), ('{"a": {"b": 1}} {"c": 2}', '{"a": {"b": 1}}')])
def test_first_json(text, want):
    assert tx.first_json(text) == want


def test_numbered_lines(spark):
    row = spark.createDataFrame([(["p", "q", "r"], "1. A\n3) C\n3. D")], "o array<string>, r string")
    assert row.select(tx.numbered_lines(F.col("r"), F.col("o")).alias("x")).first()["x"] == ["A", "q", "C"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Fri, 01 Mar 2024 17:00:00 +0700", "2024-03-01 10:00:00"), ("01 Mar 2024 10:00:00 GMT", "2024-03-01 10:00:00"), ("2024-03-01T10:00:00Z", "2024-03-01 10:00:00"), ("2024-03-01 10:00:00", "2024-03-01 10:00:00"),
        ("01/03/2024 10:00:00", "2024-03-01 10:00:00"), ("01/03/2024 10:00", "2024-03-01 10:00:00"), ("2024-03-01", "2024-03-01 00:00:00"), ("no date", None), ("", None),
    ],
)
def test_dates(spark, raw, want):
    got = one(spark, tx.parse_date(F.col("t")).cast("string"), t=raw)
    assert got == want


@pytest.mark.parametrize(("name", "want"), [("a/b\\c:*?", "abc"), ("CON.txt", "_CON.txt"), ("  . ", "khong-ten"), ("x" * 100, "x" * 90), (None, "khong-ten")])
def test_safe_name(spark, name, want):
    assert one(spark, tx.safe_name(F.col("t")), t=name) == want


@pytest.mark.parametrize(
    ("url", "ext"), [("http://a/b/c.PDF?x=1#y", "pdf"), ("http://a/b", ""), ("http://a/.hidden", ""), ("http://a/x%2Ezip", "zip"), ("http://a", "")]
)
def test_url_ext(spark, url, ext):
    assert one(spark, tx.url_ext(F.col("t")), t=url) == ext


def test_small_functions(spark):
    assert one(spark, tx.file_name(F.lit("http://a/get?id=1"), F.lit('Tải "xuống"'))) == "Tải  xuống.bin"
    assert one(spark, tx.header_kind(F.lit("text/html"), F.lit('attachment; filename="x.DOCX"'))) == "docx"
    assert one(spark, tx.cover_ext(F.lit("http://a/x.jpeg"), F.lit(""))) == "jpg"
    assert one(spark, tx.cover_ext(F.lit("http://a/x"), F.lit("image/webp"))) == "webp"
    assert one(spark, tx.escape_html(F.lit('a&b<c>"'))) == 'a&amp;b&lt;c&gt;"'
    assert one(spark, tx.initials(F.lit(" dấu chân  xa"))) == "DC"
    assert one(spark, tx.cap(F.lit("abcdef"), 3)) == "abc…"
    assert one(spark, tx.drop_thinking(F.lit("a<think>b</think>c<think>d"))) == "ac"
    assert one(spark, tx.doc_title(F.lit("<title>t</title><h2 class='x'>A <b>b</b></h2>"), F.lit("f"))) == "A b"
    assert one(spark, tx.doc_title(F.lit("<p>none</p>"), F.lit("f"))) == "f"
    assert one(spark, tx.without_head(F.lit("<html><head><title>x</title></head><p>a"))) == "<html><p>a"
    assert one(spark, tx.ends_well(F.lit("xong. "))) is True
    assert one(spark, tx.is_cjk(F.lit("a中"))) is True
    assert one(spark, tx.rewrite_accepted(F.lit("x" * 100), F.lit("y" * 85))) is True
    assert one(spark, tx.rewrite_accepted(F.lit("x" * 100), F.lit("y" * 181))) is False
    assert one(spark, tx.list_item(F.lit('{"a": " x ", "b": "y"}'))) == "x — y"
    assert one(spark, tx.name_map(F.lit("a = b\nnone\n c=d "))) == {"a": "b", "c": "d"}
    assert one(spark, tx.verdict_line(F.lit("3 | có | Tên")))["yes"] is True
    assert one(spark, tx.resolve(F.lit("http://a/b/c"), F.lit("../d"))) == "http://a/d"
    assert one(spark, tx.same_title(F.lit("Bóng Đá!"), F.lit("bong đá"))) is True
    assert one(spark, tx.same_title(F.lit(""), F.lit(""))) is False
    assert one(spark, tx.like_document(F.lit("Tải xuống (3 MB)"), F.lit("http://a"))) is True
    assert one(spark, tx.progress_web(F.lit(1), F.lit(3))) == 33
    assert one(spark, tx.progress_mobile(F.lit(1), F.lit(3))) == 0


def test_split_reply(spark):
    reply = "== DÀN CẢNH ==\nplan\n=== CHƯƠNG ===\n# Chương 3: x\nBody\n=== TRẠNG_THÁI ===\n{\"tieu_de\": \"t\"}"
    got = one(spark, tx.split_reply(F.col("t")), t=reply)
    assert (got["body"], got["state"]) == ("Body", '{"tieu_de": "t"}')


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=40))
def test_json_never_raises(text):
    tx.first_json(text)


def test_normal_form(spark):
    """Python is only asked where it can matter, and no text that isn't in normal form passes by."""
    import random
    import re
    import unicodedata

    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), tx._unsettled()))
    for a, b in tx.SETTLED:
        assert not any(pattern.search(chr(c)) for c in range(a, b + 1))
    rng = random.Random(3)
    pool = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in pool if unicodedata.combining(c)]
    texts = ["".join(rng.choice(marks if rng.random() < 0.3 else pool) for _ in range(rng.randint(1, 4))) for _ in range(20_000)]
    texts += ["plain", "", "e\u0301", "Tiếng Việt", "Tie\u0302\u0301ng", "\u1112\u1161\u11ab", "\uac00\u11a8", "中文", "\u212b", "a\u0327\u0301", "a\u0301\u0327"]
    assert all(unicodedata.is_normalized("NFC", t) or pattern.search(t) for t in texts)
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", tx.nfc(F.col("t")).alias("n")).collect()
    assert all(r["n"] == (None if r["t"] is None else unicodedata.normalize("NFC", r["t"])) for r in rows)


def test_odd_characters(spark):
    """the quick pattern finds what the class of all settled ranges leaves."""
    all_ = [c for c in range(0x300, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame(pd.DataFrame({"id": all_, "c": list(map(chr, all_))}))
    odd = {r["id"] for r in rows.where(F.col("c").rlike(tx._odd())).collect()}
    assert odd == set(all_) - {c for a, b in tx.SETTLED for c in range(a, b + 1)}
    assert not spark.range(1).select(F.lit("".join(map(chr, range(1, 0x300)))).rlike(tx._odd()).alias("x")).first()["x"]
