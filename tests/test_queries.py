"""Every registered query of the engine against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from scriptorium.plans import catalogue, listings, services, works  # noqa: F401


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con


def norm(rows):
    fix = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple("" if v is None else str(fix(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sql, data, name):
    got = catalogue.queries()[name](spark, data)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    text = catalogue.oracle_sql().get(name)
    if text is None:
        assert rows
        return
    want = sql.execute(text)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in want.fetchall()]
    strip = lambda rs: [[x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in r] for r in rs]
    assert norm(strip(rows)) == norm(strip(want))


def odd_documents(folder):
    """Documents without lines, with lines like headings and rules, with other blanks, alone in their book, and without source or number."""
    texts = [
        "a\nb  c", "", None, " \n\t\n", "Chapter 3\nx", "Ten\n-------\ny", "-------", "\u00a0\nz\u3000\n\u2028q\r\n\x1cr\x85", "第3章\n" * 3, "Hồi 1\nPhần 2\n|\n||", "  last \x0b\f\r\n\n end", "$1\\n\n",
        "x\n" * 460, "\u2003w\u1680\n\u202f\u205f\n\u2000v\u200a u\u200b",
    ]
    rows = [(i * 40 + 7, t, s) for s in ("b", None) for i, t in enumerate(texts)] + [(None, "no number\nChapter 1", "b"), (3, "one\ntwo", "single"), (5, None, "none"), (6, "", "blank"), (9, "Chapter 9\n------\nw", "head")]
    rows += [(10_000 + i, f"Chapter {i}\nt" if i % 3 else "", "many") for i in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, 'en')", rows)
    con.execute(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")
    return con


@pytest.mark.parametrize("name", ["split_chapters", "split_fallback"])
def test_odd_books(spark, tmp_path, name):
    """what a document holds makes no other chapters, and none shifts the numbers of those after it."""
    con = odd_documents(tmp_path)
    got = catalogue.queries()[name](spark, str(tmp_path))
    want = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert norm(map(tuple, got.select(*names).collect())) == norm(want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
