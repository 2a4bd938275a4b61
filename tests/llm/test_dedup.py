"""Exact dedup, near duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import exact_dedup, jaccard_join, substring_dedup
from scriptorium.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed):
    """Unlike texts, chains of near copies, copies, shared passages, short and empty texts, ties of case."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    rows, base = [], words(rng, 120)
    for i in range(12):
        rows.append(" ".join(base))
        base = base[:]
        base[rng.randrange(len(base))] = f"edit{i}"
    rows += [" ".join(words(rng, rng.randrange(1, 40)) + passage[: rng.randrange(40, 71)] + words(rng, rng.randrange(0, 200))) for _ in range(12)]
    rows += [" ".join(words(rng, rng.randrange(1, 14), 6)) for _ in range(40)]
    rows += [None, "", " \t", "one", "One", "one two three", "a b c d e", "A b C d e", "a b c d e", "x " * 400, "x " * 130]
    rows += rows[:3] + [r.upper() for r in rows[3:5]]
    return list(enumerate(rows))


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == near_brute(rows)


def test_near_duplicates_without_light_sets(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(jaccard_join, "light_boundary", lambda *_: 1)
    monkeypatch.setattr(jaccard_join, "PAIRS_A_POSTING", 0)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == near_brute(rows)


def test_near_duplicates_with_many_light_sets(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(jaccard_join, "light_boundary", lambda *_: 40)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 2)  # lists are dealt out by class
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == near_brute(rows)


@pytest.mark.parametrize("seed", [21, 22, 23, 24])
def test_near_copies_of_hot_heavy_texts(spark, monkeypatch, seed):
    rng, rows = random.Random(seed), []
    for group in range(6):
        text = [f"g{group}"] + words(rng, 120, 10_000)
        near = text[:60] + [f"edit{group}"] + text[61:]
        rows += [" ".join(text)] * 12 + [" ".join(near)]
    rows = list(enumerate(rows))
    monkeypatch.setattr(jaccard_join, "light_boundary", lambda *_: 1)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 4)  # a hot group's lists are dealt out, with one class in each
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == near_brute(rows)


def test_boundary_grows_with_the_lists():
    found = [jaccard_join.light_boundary(x) for x in (1.0, 2.0, 4.0, 16.0)]
    assert found == sorted(found) and found[0] >= 1 and found[-1] > found[0]


def test_near_edges(spark):
    rows = [(5, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 1), (None, "a b c d e f", None, 2), (7, "other words that are here now", "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string, component_id long")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == [(-1, 5), (5, 5), (5, 5), (7, 7)]
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [5, 7]
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(400, 500)] + [(i, i + 1) for i in range(600, 640)] + [(9, 9), (None, 3), (3, None)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(x, find(x)) for x in parent}
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(spark, keep):
    rows = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "a "), (7, "x" * 5000), (8, "x" * 5000), (8, "x" * 5000), (None, "a"), (None, "z")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), keep=keep).collect()
    groups: dict = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    best = lambda x: (max if keep == "largest" else min)((d for d in x if d is not None), default=None)
    want = sorted((str(d), str(best(groups[t or ""])), len(groups[t or ""]), d == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies_cut_into_runs(spark, monkeypatch, keep):
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 7)
    monkeypatch.setattr(exact_dedup, "RUN_BYTES", 2000)
    rng = random.Random(8)
    texts = ["same head " * 5 + x for x in "abc"] + ["z" * 900, "y"]
    rows = [(i, texts[rng.choice([0, 0, 0, 0, 1, 2, 3, 4])]) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    groups: dict = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    best = max if keep == "largest" else min
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs, keep=keep).collect()}
    assert got == {(d, best(groups[t]), len(groups[t])) for d, t in rows}
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs, keep=keep).collect()) == sorted(best(x) for x in groups.values())


def test_neighbours_decide_all_groups(spark, data):
    """Every group of copies is one run of the content sort, so none is joined by a digest."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    runs = exact_dedup._runs(rows, "largest").collect()
    assert not any(r["cut"] for r in runs)
    assert sum(r["place"] == 1 for r in runs) == rows.select("body").distinct().count() < len(runs)


def test_exact_edges(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (3, "b", None)], "doc_id long, text string, kept string")
    assert sorted(map(tuple, exact_dedup.drop_copies(docs).collect())) == [(2, "a", "y"), (3, "b", None)]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def repeats_brute(rows, window):
    w = {i: WORD.findall(t or "") for i, (_, t) in enumerate(rows)}
    first: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            for j in range(len(w[i]) - window + 1):
                k = tuple(w[i][j : j + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        gone = set()
        for j in range(len(w[i]) - window + 1):
            if d is not None and first[tuple(w[i][j : j + window])] < d:
                gone.update(range(j, j + window))
        out.append((d, len(w[i]), len(gone), " ".join(x for j, x in enumerate(w[i]) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "window"), [(1, 50), (2, 50), (3, 8), (4, 8)])
def test_repeats(spark, seed, window):
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    rows += [(rows[0][0], "other " * 60), (None, rows[1][1]), rows[2], (10**6, " ".join(["lap"] * 130)), (10**6 + 1, " ".join(["lap"] * 90 + ["end"]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), window)
    assert sorted(map(tuple, got.collect()), key=str) == repeats_brute(rows, window)


def test_repeats_small_vocabulary(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), 8)
    assert sorted(map(tuple, got.collect()), key=str) == repeats_brute(rows, 8)


def test_paths_compact_through_joins(spark):
    """A long copied text is one path, its source at its coordinates; a common passage within other texts splits no more than it must."""
    rng = random.Random(31)
    text = words(rng, 900, 10**6)
    rows = [(7, " ".join(text)), (9, " ".join(text)), (3, " ".join(words(rng, 40, 10**6) + text[200:500] + words(rng, 60, 10**6)))]
    docs = spark.createDataFrame(rows, SCHEMA)
    every = substring_dedup.repeated_spans(docs).collect()
    spans = [r for r in every if r["words"] > 50]  # whole paths
    found = {r["doc_id"]: sorted((r["start"], r["words"], r["source"]) for r in spans if r["doc_id"] == r2) for r in spans for r2 in [r["doc_id"]]}
    assert sorted(found) == [7, 9]
    assert len(found[7]) == 1 and found[7][0][2] == 3 and found[7][0][0] >= 200 and sum(found[7][0][:2]) <= 500 and found[7][0][1] > 200
    assert len(found[9]) == 3 and {x[2] for x in found[9]} == {3, 7}
    for r in every:
        source = dict(rows)[r["source"]]
        own = dict(rows)[r["doc_id"]].split()[r["start"] : r["start"] + r["words"]]
        assert " ".join(own) in source and hashlib.sha256(" ".join(own).encode()).digest()[:16] == r["digest"]
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()), key=str) == repeats_brute(rows, 50)


def test_compaction_of_chains(spark):
    """Chains of any length against a plain walk."""
    rng = random.Random(6)
    nodes = list(range(1, 400))
    rng.shuffle(nodes)
    chains, at = [], 0
    while at < len(nodes):
        n = rng.choice([1, 2, 3, 50])
        chains.append(nodes[at : at + n])
        at += n
    rows = [(v, (c[i + 1] if i + 1 < len(c) else 0), (c[i + 1] if i + 1 < len(c) else 0), 2 + ci, 1 + v % 5) for ci, c in enumerate(chains) for i, v in enumerate(c)]
    got = substring_dedup.compacted(spark.createDataFrame(rows, "node long, next_low long, next_high long, passes long, n int"))
    assert {tuple(r) for r in got.collect()} == {(c[0], sum(1 + v % 5 for v in c)) for c in chains}


def test_words_are_held_against_the_source(spark, monkeypatch):
    """Spans whose words aren't those at the source's coordinates stay, whatever the hashes say."""
    monkeypatch.setattr(substring_dedup, "_open_paths", lambda window: lambda batches: (pa.RecordBatch.from_arrays([pa.array([r["node"] for w in b.column(2).to_pylist() for r in w], pa.int64()), *(pa.nulls(sum(map(len, b.column(2).to_pylist())), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())), pa.array([b"wrong"] * sum(map(len, b.column(2).to_pylist())), pa.binary())], names=["node", "path", "place", "window", "doc_id", "digest"]) for b in batches))
    text = " ".join(words(random.Random(1), 200, 10**6))
    got = substring_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, text)], SCHEMA)).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_repeats_edges(spark):
    docs = spark.createDataFrame([(1, "x y", 3, "z")], "doc_id long, text string, mark long, node string")
    assert tuple(substring_dedup.remove_repeats(docs).first()) == (1, 2, 0, "x y")
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
