"""The stages, each against what its operator decides, and the queries that have SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from scriptorium.llm import queries
from scriptorium.session import durable


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        docs = durable(out, f"test-{name}")
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert all(texts[0][d] == t for d, t in rows), name
        texts.append(rows)
    start = set(texts[0])
    identified, exact, near, mixed = (texts[i] for i in (1, 2, 3, 4))
    assert {d for d, _ in identified} == start  # every document of the table is clean text in a known language
    best: dict = {}
    for d, t in identified:
        best[t] = max(best.get(t, d), d)
    assert sorted(d for d, _ in exact) == sorted(best.values())
    from tests.llm.test_dedup import near_brute

    assert sorted(d for d, _ in near) == sorted({c for _, _, c in near_brute(exact)})
    assert {d for d, _ in mixed} <= {d for d, _ in near} and max(sum(1 for x, _ in mixed if x == d) for d, _ in mixed) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).toPandas()
    assert set(packed.doc_id) == {d for d, _ in mixed}


def test_run(spark, data):
    got = corpus_pipeline.run(spark, data).toPandas()
    sums = got.groupby("sequence_id").length.sum()
    assert len(got) and sums.max() <= 4096 and 4096 * len(sums) - sums.sum() <= 0.05 * sums.sum()


NAMES = "doc_id long, text string, lang string, source string, n_chars long, mark string, copies_ long, kept_id_ long, good_id long, body string, row string, k string, times int, head string, `a.b` string"


def rows_with_all_names():
    """Nulls, empty and blank texts, junk, copies, near copies, repeated rows and a long text, under names that operators use."""
    body = " ".join(f"the word number {i} of many" for i in range(60))
    texts = [body, body, body + " more", None, "", " \t", "12 34", "中文" * 40, "the cat went home to the other house", "word other " * 50_000, "the cat went home to the other house"]
    rows = [(i, t, None if i == 7 else "en", "web" if i % 3 else None, len(t or ""), f"m{i}", i, None, i, "b", "r", "k", 1, "h", "d") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, body + " null", "en", "web", 1, "n", None, None, None, "b", None, "k", 1, "h", "d")]


def test_stages_keep_rows_whole(spark, data):
    rows = rows_with_all_names()
    docs = spark.createDataFrame(rows, NAMES)
    kept = {name: [tuple(r) for r in stage(spark, docs, data).collect()] for name, stage in corpus_pipeline.STAGES[:-1]}
    for name, found in kept.items():
        assert found and set(found) <= set(rows), name  # whole rows, none of them changed
    ids = {name: sorted((r[0] is None, r[0] or 0) for r in found) for name, found in kept.items()}
    plain = lambda *x: [(False, i) for i in x]
    assert ids["language_id"] == sorted([*plain(0, 0, 1, 2, 8, 9, 10), (True, 0)])  # no letters, or letters that no row taught
    assert ids["exact_dedup"] == sorted([*plain(1, 2, 4, 5, 6, 7, 9, 10), (True, 0)])
    assert ids["near_dedup"] == plain(0, 3, 4, 5, 6, 7, 8, 9)
    assert set(ids["mixing"]) >= set(plain(3, 4, 5))  # texts without words cost nothing
    packed = corpus_pipeline.packing(spark, docs, data).toPandas()
    assert packed.doc_id.isna().sum() and set(packed.doc_id.dropna()) == set(range(11))


def test_stages_of_no_documents(spark, data):
    docs = spark.createDataFrame([], NAMES)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    got = queries.queries()[name](spark, data)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
