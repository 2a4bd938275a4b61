"""Archives, URL decisions, languages, mixing, neighbours and language-model scores."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import language_id, lm_score, mixing, neighbours, url_filter, warc

# ---------------------------------------------------------------- archives

PAGE = "page_id long, url string, html string"


def test_archives(spark):
    body = "<p>" + "text é " * 40
    rows = [(3, "http://a", body), (1, "http://b\r\nX: y", body), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", body), (1, "http://b\r\nX: y", body), (8, "u", "\x00 \r\n\r\n" * 30)]
    rows += [(100 + i, f"http://c/{i}", f"<p>page {i} " + "filler " * (i % 40)) for i in range(200)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGE)).collect()
    import hashlib

    data = {i: (h or "").encode() for i, (_, _, h) in enumerate(rows)}
    heads: dict = {}
    for (p, _, _), raw in zip(rows, data.values()):
        if len(raw) >= 100 and p is not None:
            heads[raw] = min(heads.get(raw, p), p)
    want = []
    for (p, u, _), raw in zip(rows, data.values()):
        head = heads.get(raw)
        revisit = head is not None and p is not None and p != head
        uri = u and u.replace("\r", "%0D").replace("\n", "%0A")
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", head if revisit else None, uri))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_archive_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"urn:page:{i}", "http://a", bytearray(b"payload %d " % i * 20), "0" * 64, None) for i in range(60)], "record_id string, uri string, payload binary, digest string, refers_to string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(rows, path)
    [file] = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    raw = file.read_bytes()
    assert struct.unpack_from("<I", raw)[0] == 0x184D2A5D  # the dictionary leads
    assert len(list(warc.read_frames(raw))) == 60
    bad = warc.read_archives(spark, path, errors="collect")  # the digests given are wrong
    assert {r["error"] for r in bad.collect()} == {"the payload's digest differs from its header"}
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, path).collect()
    (file.parent / f".{file.name}.crc").unlink()
    file.write_bytes(raw[:-30])
    assert any("cut off" in (r["error"] or "") for r in warc.read_archives(spark, path, errors="collect").collect())


def test_foreign_archive():
    record = warc.build_record("urn:x", None, b"abc", __import__("hashlib").sha256(b"abc").hexdigest(), None)
    plain = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    frame = plain.compress(record) + plain.flush()
    assert list(warc.read_frames(frame + struct.pack("<II", 0x184D2A53, 3) + b"abc" + frame)) == [record, record]
    assert warc.parse_record(record)["payload"] == b"abc"
    for wrong in (record[:-2], record.replace(b"Content-Length: 3", b"Content-Length: 4"), record.replace(b"WARC-Date", b"X-Date"), record.replace(b"abc\r", b"abd\r"), b"", b"WARC/1.1\r\nnocolon\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse_record(wrong)
    for wrong in (b"1234567", b"not a frame at all", frame[:-1]):
        with pytest.raises(ValueError):
            list(warc.read_frames(wrong))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


# ---------------------------------------------------------------- URLs


def test_aliases(spark):
    rows = [
        (1, "http://a.com/en/x", '<link rel="canonical" href="http://b.org/q">'), (2, "https://b.org/q#f", None), (3, "http://c.org/", '<META HTTP-EQUIV="refresh" content="0; URL=http://b.org/q">'),
        (4, "http://d.example.com/en/7", "<link href=/en/9 rel=canonical>"), (5, "http://d.example.com/en/9", ""), (6, None, None), (7, "nothing", ""), (8, "http://D.example.COM/fr?x", "<link href='en/7' rel=canonical>"),
        (9, "http://e.org/1", '<link rel=canonical href="http://x.com/en/off">'), (10, "http://f.org/1", '<link rel=canonical href="http://[bad">'), (10, "http://f.org/1", ""),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], PAGE + ", verdict string")
    got = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(docs, url_filter.RULES).orderBy("page_id").collect()]
    assert got == [
        (1, "a.com", "com/en/", "block"), (2, "b.org", None, "block"), (3, "c.org", None, "block"), (4, "d.example.com", "example.com/en/7", "allow"), (5, "d.example.com", "com/en/", "block"),
        (6, "", None, "allow"), (7, "", None, "allow"), (8, "d.example.com", None, "allow"), (9, "e.org", None, "block"), (10, "f.org", None, "allow"), (10, "f.org", None, "allow"),
    ]
    assert url_filter.judge_urls(docs.limit(0), url_filter.RULES).count() == 0


def test_odd_markup(spark):
    rows = [(1, "http://a.org/en/x", "<![x[y]]><base href='http://b.com/en/'><link rel='canon&#105;cal' href=q>"), (2, "http://[bad", "<link rel=canonical href=x>"), (3, "http://c.org/", "<![CDATA[ <link rel=canonical href='http://z.com/en/'>")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGE), url_filter.RULES).collect()}
    assert got[1] == "block" and set(got) == {1, 2, 3}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>![]-/?&;#x= '\"linkrelcanoicbsmthp:.", max_size=60))
def test_any_markup_is_read(html):
    list(url_filter.same_as("http://a.org/", html))


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_spread_as_by_a_plain_search(spark, seed):
    """Verdicts against a breadth-first search from every URL over canonical links and a redirect log."""
    rng = random.Random(seed)
    urls = [f"http://h{i}.{rng.choice(['com', 'org', 'net', 'io'])}/{rng.choice(['en', 'de', 'es', 'x'])}/{i}" for i in range(60)]
    links = [(rng.choice(urls), rng.choice(urls)) for _ in range(35)]
    log = [(rng.choice(urls), rng.choice(urls)) for _ in range(10)]
    goal = dict(links)
    pages = [(i, u, f"<link rel=canonical href='{goal[u]}'>" if u in goal else "") for i, u in enumerate(urls)]
    near: dict = {u: set() for u in urls}
    for a, b in [*goal.items(), *log]:
        near[a].add(b)
        near[b].add(a)

    def own(u):
        host, path = u[7:].split("/", 1)
        fits = [(len(r.host + r.path), r.action) for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fits)[1] if fits else None

    def verdict(u):
        seen, todo = {u}, [u]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        said = {own(x) for x in seen}
        return own(u) or ("block" if "block" in said and "allow" not in said else "allow")

    got = url_filter.judge_urls(spark.createDataFrame(pages, PAGE), url_filter.RULES, spark.createDataFrame(log, "src string, dst string"))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {i: verdict(u) for i, u in enumerate(urls)}


def test_redirect_log(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", "") for i in range(6)], PAGE)
    log = spark.createDataFrame([("http://h0.org/", "https://h1.org/#x"), ("http://h1.org/", "http://z.com/en/"), ("http://h2.org/", "http://h3.org/"), (None, "x")], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, url_filter.RULES, log).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}
    assert {r["verdict"] for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="htp:/?#.AaÉ-x\n", max_size=25))
def test_address_has_no_fragment(url):
    assert "#" not in url_filter.address(url)


# ---------------------------------------------------------------- languages


def test_kneser_ney_sums_to_one():
    model = language_id.fit(["abracadabra banana", "a cab", "bad"])
    chars, doc = language_id.folded(["abracad"])
    place = language_id._places(doc)
    letters = [0, *range(ord("a"), ord("z") + 1)]
    for order in (1, 2, 3, 4):
        total = 0.0
        for c in [*letters, 0x4E2D]:
            test = np.append(chars, c).astype(np.uint32)
            at, where = np.array([len(chars)]), np.append(place, place[-1] + 1)
            p = np.full(1, 1 / language_id.ALPHABET)
            for n, (keys, own, known, weights) in enumerate(model[:order], 1):
                g, k = language_id.gram_hashes(test, where, at, n), language_id.gram_hashes(test, where, at, n - 1, 1)
                p = language_id._look_up(keys, own, g, 0.0) + language_id._look_up(known, weights, k, 1.0) * p
            # A letter that was never seen stands for all that are neither seen nor in the list.
            total += float(p[0]) * (language_id.ALPHABET - len(letters) if c == 0x4E2D else 1)
        assert total == pytest.approx(1, abs=1e-4)


def kneser_ney_brute(texts, word, order=4):
    """Bits per character of a word, with counts held in dictionaries of strings."""
    from collections import defaultdict

    seen: list[dict] = [defaultdict(int) for _ in range(order + 1)]
    for t in texts:
        t = "_" * order + t.lower().replace(" ", "_")
        for i in range(order, len(t)):
            seen[order][t[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        for g in seen[n + 1]:
            seen[n][g[1:]] += 1

    def chance(g):
        if not g:
            return 1 / language_id.ALPHABET
        counts = seen[len(g)]
        one, two = (sum(c == k for c in counts.values()) for k in (1, 2))
        off = one / (one + 2 * two) if one else 0.5
        after = [c for x, c in counts.items() if x[:-1] == g[:-1]]
        if not after:
            return chance(g[1:])
        return max(0.0, counts.get(g, 0) - off if g in counts else 0.0) / sum(after) + off * len(after) / sum(after) * chance(g[1:])

    padded = "_" * order + word.lower().replace(" ", "_")
    return sum(-np.log2(chance(padded[i - order + 1 : i + 1])) for i in range(order, len(padded))) / len(word)


def test_kneser_ney_against_brute_force():
    texts, words = ["abracadabra banana", "a cab", "bad cab bad"], ["abra", "bandana", "cab zoo", "b"]
    bits, letters, n = language_id.cross_entropies(words, [language_id.fit(texts)])
    assert letters.all() and n.tolist() == [len(w) for w in words]
    assert bits[:, 0] == pytest.approx([kneser_ney_brute(texts, w) for w in words], rel=1e-5)


def test_models_in_blocks(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "中文" * 20)], "doc_id long, text string"), allowMissingColumns=True)
    one = {r["doc_id"]: r for r in language_id.identify(docs, docs).collect()}
    monkeypatch.setattr(language_id, "MODEL_BYTES", 1)  # each model is a block
    several = {r["doc_id"]: r for r in language_id.identify(docs, docs).collect()}
    assert all((r["lang_pred"], r["rejected"]) == (several[d]["lang_pred"], several[d]["rejected"]) and r["score"] == pytest.approx(several[d]["score"]) for d, r in one.items())


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 100)
    train = spark.createDataFrame([(i, "the cat and the dog went home " * (200 if i == 0 else 1) + chr(97 + i), "en") for i in range(20)], "doc_id long, text string, lang string")
    assert language_id.identify(train, train).where("lang_pred = 'en'").count() == 20


def test_languages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    from scriptorium.llm import queries

    got = {r["doc_id"]: r for r in queries.queries()["op6_language_id"](spark, data).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d]["held_out"] == (d in held) for d in truth)
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) >= 0.95 * len(held)


def test_language_edges(spark):
    train = spark.createDataFrame([(i, "the cat and the dog went home", "en") for i in range(30)] + [(i, "le chat et la souris sont là", "fr") for i in range(30)] + [(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, None, "b"), (2, "", "b"), (3, "12 !? ", "b"), (4, "the dog", "b"), (5, "la souris", "b"), (6, "the " * 40000, "b"), (None, "中文" * 50, "b"), (4, "the dog", "b")], "doc_id long, text string, lang_pred string")
    got = language_id.identify(docs, train).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and [by[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6)] == ["und", "und", "und", "en", "fr", "en"]
    assert [by[i]["rejected"] for i in (1, 4, 5, 6, None)] == [True, False, False, False, True] and by[1]["score"] == 0
    kept = language_id.keep_identified(docs, train)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 4, 5, 6]
    assert {r["lang_pred"] for r in language_id.identify(docs, train.limit(0)).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), train).count() == 0


@pytest.mark.parametrize("texts", [1, 3])
def test_languages_of_few_texts(spark, texts):
    """Copies of few texts teach their language, too, and count once."""
    few = {lang: [f"{body} {i}x" for i in "abc"[:texts]] for lang, body in {"en": "the cat and the dog went home", "fr": "le chat et la souris sont là", "de": "der hund und die katze gehen", "es": "el perro y los gatos se van"}.items()}
    train = spark.createDataFrame([(i, x[i % texts], lang) for lang, x in few.items() for i in range(3000)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(i, x[0], None) for i, x in enumerate(few.values())], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, train).collect()}
    assert got == dict(enumerate(few))


# ---------------------------------------------------------------- mixing


@pytest.mark.parametrize("window", [2, 50, mixing.WINDOW])
@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(0, 5), min_size=1, max_size=5), st.integers(1, 6), st.integers(0, 2000), st.integers(0, 9))
def test_budget_is_the_nearest_sum(window, counts, unit, budget, seed):
    """Of all sums of all choices, not only those above some start."""
    lengths, n = [a * unit for a in counts], list(counts.values())
    sums = {0}
    for a, c in zip(lengths, n):
        sums = {x + a * k for x in sums for k in range(c + 1)}
    before, mixing.WINDOW = mixing.WINDOW, window
    try:
        taken = mixing.fit_budget(lengths, n, budget, seed)
    finally:
        mixing.WINDOW = before
    assert all(0 <= t <= c for t, c in zip(taken, n))
    got = sum(a * t for a, t in zip(lengths, taken))
    assert abs(got - budget) == min(abs(x - budget) for x in sums)


@pytest.mark.parametrize("seed", range(30))
def test_budget_of_even_lengths(seed):
    """The one document of odd length decides, wherever the order has it."""
    lengths = [*range(2, 2001, 2), 1]
    half = sum(lengths) // 4 * 2
    for budget in (half, half + 1):
        taken = mixing.fit_budget(lengths, [1] * len(lengths), budget, seed)
        assert sum(a * t for a, t in zip(lengths, taken)) == budget


def test_budget_out_of_reach():
    assert mixing.fit_budget([1000, 7], [1_000_000, 3], 500_000_500) == [500_000, 3]
    assert mixing.fit_budget([38, 9], [2, 3], 35) == [1, 0]
    assert mixing.fit_budget([5], [3], 100) == [3] and mixing.fit_budget([], [], 5) == [] and mixing.fit_budget([0], [9], 5) == [0]


def test_large_budgets():
    rng = random.Random(4)
    lengths = rng.sample(range(50, 9000), 300)
    counts = [rng.randrange(1, 40) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts))
    for share in (0.001, 0.37, 0.999):
        taken = mixing.fit_budget(lengths, counts, int(total * share))
        assert sum(a * t for a, t in zip(lengths, taken)) == int(total * share) and all(0 <= t <= c for t, c in zip(taken, counts))


def targets_brute(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 50)), rng.choice(["a", "b", "b", "b", "b", "Z", "é", None])) for i in range(300)]
    rows += [(1000 + i, "x y", "tiny") for i in range(2)] + [(2000, None, "empty"), (2001, "  ", "empty"), (7, rows[7][1], rows[7][2]), (None, "q q", "a")] + [(3000 + i, "five words are in here", "same") for i in range(100)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, taken long")
    got = mixing.mix(docs).toPandas()
    sizes: Counter = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_brute(dict(sizes))
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    src = {(d, len((t or "").split())): s for d, t, s in rows}
    got["source"] = [src[(None if d != d else int(d), n)] for d, n in zip(got.doc_id, got["size"])]
    for s in want:
        g = got[got.source.isna() if s is None else got.source == s]
        assert np.allclose(g.target, want[s]) and set(g.source_size) == {sizes[s]}
        assert abs(g.taken.sum() - want[s]) <= (3 if s != "same" else 5)
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "mark", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in taken.collect()) == got.taken.sum()
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take_mix(docs.where("source = 'empty'")).count() == 2


# ---------------------------------------------------------------- neighbours


def nearest_brute(rows, k=5):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good.append((i, x / np.abs(x).max()))
    out = set()
    for q, v in good:
        if q % 50 == 0:
            near = sorted((-round(float(v @ w / math.sqrt(v @ v) / math.sqrt(w @ w)), 12), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out |= {(q, r, i) for r, (_, i) in enumerate(near, 1)}
    return out


def test_neighbours_exact_on_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0, None]), (50, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (9, [-1e-200, 1e-200])]
    got = neighbours.nearest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string"), lambda i: i % 50 == 0)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()} == nearest_brute(rows)
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 50 == 0).count() == 0


def test_neighbours_with_copies(spark):
    rng = np.random.default_rng(1)
    one = rng.normal(size=8).tolist()
    rows = [(i, one) for i in range(120)] + [(200 + i, (np.array(one) + rng.normal(size=8) * 1e-3).tolist()) for i in range(10)]
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect()}
    assert {x for x in got if x[0] < 200} == {(q, r, i) for q in (0, 50, 100) for r, i in enumerate([x for x in range(7) if x != q][:5], 1)}


def test_recall(spark, data):
    from scriptorium.llm import queries

    rows = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    got = queries.queries()["op8_neighbours"](spark, data).toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rows.vec_id.to_numpy()
    hit = 0
    for q, g in got.groupby("query_id"):
        at = int(np.flatnonzero(ids == q)[0])
        s = x @ x[at]
        for r in g.itertuples():
            assert r.score == pytest.approx(s[np.flatnonzero(ids == r.vec_id)[0]], abs=1e-12)
        s[at] = -9
        hit += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(g.vec_id))
    assert len(got) == 5 * (ids % 50 == 0).sum() and hit >= 0.9 * len(got)


def clustered(n, d=32, groups=200, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, d))


def test_recall_on_clusters(spark):
    """Few probes are enough there: the candidates are a small share of all, and the neighbours found are the true ones."""
    x = neighbours.unit(clustered(4000))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(docs, lambda i: i % 50 == 0).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5]) & set(g.vec_id))
    assert len(got) == 5 * 80 and hit >= 0.9 * len(got)
    queries = x[::50]
    true = np.argsort(-(queries @ x.T - 9 * (np.arange(4000) == np.arange(0, 4000, 50)[:, None])), axis=1)[:, :5]
    probes = neighbours.probes_for(np.repeat(queries, 5, axis=0), x[true.reshape(-1)], 4, 1)
    seen = np.zeros((80, 4000), bool)
    for t in range(4):
        own = neighbours.buckets(x, t, 1, 1)[:, 0]
        for p in neighbours.buckets(queries, t, 1, probes).T:
            seen |= own == p[:, None]
    assert seen.mean() < 0.1 and np.take_along_axis(seen, true, 1).mean() >= 0.95


def test_buckets_of_two_rotations():
    x = neighbours.unit(np.random.default_rng(3).normal(size=(5, 8)))
    assert neighbours.depth_of(100, 64) == 1 and neighbours.depth_of(10**7, 64) == 2 and neighbours.depth_of(10**9, 64) == 3
    got = neighbours.buckets(x, 1, 2, 256)
    signed = [np.stack([y, -y], axis=2).reshape(5, -1) for y in (neighbours.rotate(x, 2), neighbours.rotate(x, 3))]
    for i in range(5):
        sums = (signed[0][i][:, None] + signed[1][i][None, :]).reshape(-1)
        assert sorted(got[i]) == list(range(256)) and np.allclose(sums[got[i]], np.sort(sums)[::-1])
    assert neighbours.probes_for(x, x, 2, 2) == 1 and neighbours.probes_for(x, -x, 1, 1, most=1) is None


def test_queries_against_all_where_probes_fall_short(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "probes_for", lambda *_: None)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(6).normal(size=(150, 6)))]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()} == nearest_brute(rows)


def test_rotation_keeps_lengths():
    x = neighbours.unit(np.random.default_rng(2).normal(size=(7, 24)))
    y = neighbours.rotate(x, 3)
    assert y.shape == (7, 32) and np.allclose(x @ x.T, y @ y.T)
    assert (neighbours.axes(np.array([[0.1, -0.9, 0.5]]), 2) == [[3, 4]]).all()


# ---------------------------------------------------------------- language-model scores


def scores_brute(rows):
    """The same models over whole words."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    v = len({w for t in tokens for w in t})

    def counts(chosen):
        w, c, p = Counter(), Counter(), Counter()
        for i in chosen:
            for a, b in zip(["<s>", *tokens[i][:-1]], tokens[i]):
                w[b] += 1
                c[a] += 1
                p[a, b] += 1
        return w, c, p

    models = [counts([i for i, r in enumerate(rows) if r[2]]), counts(range(len(rows)))]
    out = []
    for i, (_, _, own) in enumerate(rows):
        mean = []
        for (w, c, p), learned in zip(models, (own, True)):
            ow, oc, op = counts([i]) if learned else (Counter(), Counter(), Counter())
            bits = 0.0
            for a, b in zip(["<s>", *tokens[i][:-1]], tokens[i]):
                single = (w[b] - ow[b] + 1) / (sum(w.values()) + v)
                bits -= math.log2((p[a, b] - op[a, b] + lm_score.PRIOR * single) / (c[a] - oc[a] + lm_score.PRIOR))
            mean.append(bits / max(1, len(tokens[i])))
        out.append((len(tokens[i]), *mean, mean[0] - mean[1]))
    return out


def test_scores(spark):
    rng = random.Random(8)
    good, bad = ["river", "stone", "light", "hill"], ["click", "buy", "now", "free"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randrange(5, 60))), bool(i % 3 == 1)) for i in range(60)] + [(100, None, True), (101, " ", False), (102, "alone", None), (3, "buy now", False)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, good boolean, score double")
    from pyspark.sql import functions as F

    got = lm_score.score_documents(docs.coalesce(1), F.col("good")).collect()
    for r, want in zip(got, scores_brute(rows)):
        assert (r["n_tokens"], r["loss_target"], r["loss_background"], r["score"]) == pytest.approx(want, abs=1e-9)
    mean = lambda k: np.mean([r["score"] for r in got if r["doc_id"] < 60 and bool(r["doc_id"] % 3) == k])
    assert mean(True) < mean(False)
    assert lm_score.score_documents(docs.limit(0), F.col("good")).count() == 0
    assert lm_score.score_documents(docs, F.lit(False)).count() == len(rows)


def scored(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").repartition(3)
    got = {r["doc_id"]: (r["n_tokens"], r["loss_target"], r["loss_background"], r["score"]) for r in lm_score.score_documents(docs, F.col("good")).collect()}
    return [got[d] for d, _, _ in rows]


def test_scores_tell_all_words_apart(spark):
    """Of thousands of words and bigrams, none is counted for another."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(400)), i % 2 == 1) for i in range(40)]
    for got, want in zip(scored(spark, rows), scores_brute(rows)):
        assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("range_text", [1 << 30, 64])
def test_vocabulary_and_ranges_grow(spark, monkeypatch, range_text):
    """The vocabulary is the corpus's own; hundreds of ranges and chunks give what few do."""
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{(i + 7 * k + rng.randrange(40)) % 256}" for k in range(90)), i % 3 == 1) for i in range(60)] + [(60, None, True), (61, " ", False), (62, "long " * 30_000, False)]
    monkeypatch.setattr(lm_score, "RANGE_TEXT", range_text)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 2000)
    for x, want in zip(scored(spark, rows), scores_brute(rows)):
        assert x == pytest.approx(want, abs=1e-9)
