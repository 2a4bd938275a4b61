"""Retries, budgets and odd markup."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.functions import html as hx
from scriptorium.sources import client, readers


def test_fetch_one():
    slept: list[float] = []
    answers = iter([(503, b"", ""), OSError("reset"), (200, "é".encode(), "iso-8859-1")])

    def get(url):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert client.fetch_one("http://a/", get, sleep=slept.append) == (200, "é", 3)
    assert slept == [0.8, 1.6] and client.pauses(6) == [0.8, 1.6, 3.2, 6.4, 8.0, 8.0]
    assert client.fetch_one("u", lambda u: (404, b"x", ""), sleep=slept.append) == (404, None, 1)
    assert client.fetch_one("u", lambda u: (500, b"x", ""), 2, sleep=slept.append) == (500, None, 3)
    assert client.text_of("ñ".encode("latin-1"), "latin-1") == "ñ" and client.text_of(b"x", "nonsense") == "x"


def test_fetch(spark):
    urls = spark.createDataFrame([(f"http://h{i % 2}/{i}",) for i in range(6)] + [(None,)], "url string").where("url IS NOT NULL")
    got = client.fetch(urls, lambda u: (200, u.encode(), "utf-8"), spacing=0.0).collect()
    assert sorted((r["url"], r["text"], r["tries"]) for r in got) == sorted((f"http://h{i % 2}/{i}", f"http://h{i % 2}/{i}", 1) for i in range(6))


def test_ask():
    asked: list[int] = []

    def call(answers):
        def one(budget):
            asked.append(budget)
            return answers[len(asked) - 1]

        return one

    assert client.ask(call([("a", "length"), ("abc", "length"), ("ab", "length")]), 100) == "abc" and asked == [100, 2200, 6400]
    asked.clear()
    assert client.ask(call([("abc", "length"), ("", "stop")])) == "abc"


def test_links_and_selectors():
    assert client.absolute_link("../x?y", "http://a/b/c") == "http://a/x?y" and client.absolute_link(None, "http://a/") == "" and client.absolute_link("http://[bad", "http://a/") == "http://[bad"
    assert client.quoted_selector('a[href= x y ] b[c="d"] [e]') == 'a[href="x y"] b[c="d"] [e]'


ODD = ["<![x[y]]>text", "<![CDATA[ x", "<!", "<![if !IE]><p>a</p><![endif]>", "<p>" * 50 + "x", "&#xD800;&#99999999;", "<a href='http://[bad'>x</a>"]


@pytest.mark.parametrize("html", ODD)
def test_odd_markup(html):
    hx.html_to_lines(html)
    hx.split_by_headings(html * 4)
    hx.main_block(html, "book")
    hx.main_block(html, "news")
    hx.anchors(html, "http://[bad")
    hx.anchors(html, "http://a/")
    assert hx.book_meta(html + "<meta property='og:image' content='http://[x'>", "http://[bad")["cover"] == ""
    assert "text" not in html or hx.html_to_lines(html) == ["text"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>![]-/?&;#x= '\"pah1brdivCDATA", max_size=60))
def test_any_markup(html):
    hx.html_to_lines(html)
    hx.split_by_headings(html)
    hx.anchors(html, html)


def test_headings_of_a_page():
    page = "<head><title>t</title></head>" + "opening " * 20 + "<h1>One <i>x</i></h1><p>a</p><p>b</p><div><h2></h2>c<br>d</div><h3>Empty</h3><h4>no cut</h4>"
    assert hx.split_by_headings(page) == [("Mở đầu", [("opening " * 20).strip()]), ("One x", ["a", "b"]), ("Chương 3", ["c", "d"]), ("Empty", ["no cut"])]
    assert hx.split_by_headings("<h1>a</h1>x<h2>b</h2>y") == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.sampled_from(["x.epub", "x.docx", "x.html", "x.md", "x.txt", "x.pdf", "x"]))
def test_any_file_is_read_or_named(data, name):
    got = readers.read_one(name, data)
    assert (got["error"] is None) == bool(got["chapters"])


def test_markdown_and_text_files():
    md = b"# Work\n## One\nsee [here](u) and ![pic](v)\n```\n# not a head [x](y)\n```\n## Two ##\nend"
    got = readers.read_one("w.md", md)
    assert got["title"] == "Work" and [(c["title"], c["lines"]) for c in got["chapters"]] == [("One", ["see here and pic", "# not a head [x](y)"]), ("Two", ["end"])]
    text = "Chapter 1\nfirst\n\nChapter 2: x\n-------\nsecond\nthird\nTitle over a rule\n--------\nlast"
    assert readers.split_lines(text, "t") == [("Chapter 1", ["first"]), ("Chapter 2: x", ["second", "third"]), ("Title over a rule", ["last"])]
    assert [len(x) for _, x in readers.split_lines("\n".join(map(str, range(700))), "t")] == [300, 300, 100]
    assert readers.split_lines("", "t") == [] and readers.split_lines("a\nb", "t") == [("t", ["a", "b"])]
    assert isinstance(pd.Series(readers.split_lines("a", "t")), pd.Series)
