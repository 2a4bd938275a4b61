"""Quality rules, phrase collocations and vector codes against plain programs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptorium.llm import collocations, quality_rules, vector_codes

DOCS = "doc_id long, text string, lang string, words string, n long, mark string, row int"


def docs_of(spark, rows):
    """Extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, l, "x", 1, "m", None) for i, t, l in rows], DOCS)


def prose(rng, n, words, weights):
    return " ".join(rng.choices(words, weights, k=n))


def sample_docs(seed=5):
    rng = random.Random(seed)
    vocabulary = {"en": [f"word{i}" for i in range(3000)] + ["the", "of", "And", "to."], "fr": [f"mot{i}é" for i in range(3000)] + ["le", "Là,", "de"]}
    rows, i = [], 0
    for lang, words in vocabulary.items():
        weights = [1] * 3000 + [600] * (len(words) - 3000)
        for _ in range(120):
            rows.append((i, prose(rng, rng.randint(30, 260), words, weights) + rng.choice(["", "\n\nline one\nline one\n x", "\t#*$%"]), lang))
            i += 1
    rows += [(i, prose(rng, 200, vocabulary["fr"], [1] * 3003), "en"), (i + 1, "%%% ### " * 100, "en"), (i + 2, " ".join(f"{w}&&&" for w in vocabulary["en"][-304:]), "en")]
    rows += [(i + 3, None, "en"), (i + 4, "", None), (None, "a b c a b c", "en"), (i + 5, "a b c " * 40, "en"), (i + 6, prose(rng, 90, vocabulary["en"], [1] * 3004), None), (i + 7, prose(rng, 90, vocabulary["en"], [1] * 3004), "xx")]
    rows += [rows[3]] * 40  # one text in many rows
    rows.append((i + 8, prose(rng, 60_000, vocabulary["en"], [1] * 3000 + [600] * 4), "en"))  # a very long text
    return rows


# ---------------------------------------------------------------- quality rules


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return words, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


CLASSES = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?]", r"['\"()-]", r"[#*$%&|<>]", r"[\x80-\u02ff]", r"[\u0300-\u07ff]", r"[\u0800-\uffff]", r"[\U00010000-\U0010ffff]"]


def classes_of(text):
    found = [len(re.findall(c, text)) for c in CLASSES]
    return [*found, len(text) - sum(found)]


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def js(p, q):
    keys = set(p) | set(q)
    a, b = sum(p.values()) or 1, sum(q.values()) or 1
    total = 0.0
    for k in keys:
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(0.0, total / 2))


def quality_brute(rows):
    failed = lambda c: c[1] < 50 or 100 * c[5] > 50 * c[1]
    measured = [(i, t, lang, counts_of(t)) for i, t, lang in rows]
    by_lang = defaultdict(Counter)
    for _, t, lang, c in measured:
        if lang is not None and not failed(c):
            by_lang[lang][t] += 1
    refs = {}
    for lang, texts in by_lang.items():
        words, classes = Counter(), Counter()
        for t, n in texts.items():
            times = 1 if n > 1 and n * 1000 > sum(texts.values()) else n
            for w in counts_of(t)[0]:
                words[lower(w)] += times
            for k, x in enumerate(classes_of(t)):
                classes[k] += x * times
        total = sum(words.values())
        if total >= 5000:
            common = {w: n for w, n in words.items() if n * 500 >= total}
            refs[lang] = (classes, common | {None: total - sum(common.values())})
    out = []
    for i, t, lang, c in measured:
        kept = not failed(c)
        if lang in refs:
            classes, common = refs[lang]
            if len(t or "") >= 300:
                kept &= js(dict(enumerate(classes_of(t))), classes) <= 0.32
            if c[1] >= 50:
                kept &= js(Counter(w if (w := lower(x)) in common else None for x in c[0]), common) <= 0.2 + 2 / math.sqrt(c[1])
        out.append((i, *c[1:], failed(c), kept))
    return out


def test_quality(spark):
    rows = sample_docs()
    got = quality_rules.judge_quality(docs_of(spark, rows))
    assert "class_distance" in got.columns
    found = [tuple(r) for r in got.drop("class_distance", "word_distance").collect()]
    want = quality_brute(rows)
    assert sorted(map(str, found)) == sorted(map(str, want))
    fate = {r[0]: r[-1] for r in found}
    assert not fate[240] and not fate[241] and not fate[242]  # another language's words, symbols, words with symbols
    assert sum(fate[i] for i in range(240)) >= 0.9 * sum(1 for w in want if w[0] is not None and w[0] < 240 and not w[-2])


def test_quality_of_nothing(spark):
    assert quality_rules.judge_quality(docs_of(spark, [])).count() == 0
    [row] = quality_rules.judge_quality(docs_of(spark, [(1, None, None)])).collect()
    assert (row["n_words"], row["base_failed"], row["kept"], row["class_distance"], row["word_distance"]) == (0, True, False, None, None)


def test_distance():
    rng = np.random.default_rng(3)
    p, q = rng.integers(0, 9, (50, 6)).astype(float), rng.integers(0, 9, 6).astype(float)
    p[:, 0] += 1
    want = [js(dict(enumerate(x)), dict(enumerate(q))) for x in p]
    assert np.allclose(quality_rules.distance(p, q[None, :]), want)
    assert quality_rules.distance(np.eye(2), np.eye(2)[::-1]).tolist() == [1.0, 1.0]


# ---------------------------------------------------------------- phrases


def phrases_brute(rows, least=30, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        ranked = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in cand.items())
            if not inside:
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return out


def phrase_docs(seed=11):
    rng = random.Random(seed)
    words = ["the", "of", "a", "Rome", "é", "日本", "x\x0bnew", "York City", "--", "zz"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(rng.randint(0, 90))), rng.choice(["en", "fr", None, "und"])) for i in range(260)]
    rows += [(1000 + i, "New York City Hall is there", "en") for i in range(35)] + [(2000, "one  two\tthree " * 40, "de"), (2001, None, "de"), (2002, "", None), (None, "the of a", None)]
    rows += [(3000, " ".join(rng.choices(words, k=30_000)), "long"), (3001, "q " * 20_000, "long")]
    return rows


@pytest.mark.parametrize("chunk_bytes,known_slots", [(4 << 20, 4_000_000), (3000, 4_000_000), (3000, 0)])
def test_collocations(spark, chunk_bytes, known_slots, monkeypatch):
    rows = phrase_docs()
    if chunk_bytes < 1 << 20:
        monkeypatch.setattr(collocations, "RANGE_TEXT", 1 << 15)  # several ranges
    got = collocations.collocations(docs_of(spark, rows), chunk_bytes=chunk_bytes, known_slots=known_slots)
    assert sorted(map(tuple, got.collect())) == sorted(phrases_brute(rows))


def test_many_slots_meet_no_text_without_them(spark, monkeypatch):
    """Beyond KNOWN_SLOTS no range's slots are joined to every chunk, and the counts are those of the other way."""
    rows = [(i, " ".join(f"w{(i * j) % 23} x{j % 7}." if j % 5 == 0 else f"w{(i * j) % 23} x{j % 7}" for j in range(200)), "en") for i in range(1, 60)]
    docs, plans, durable = docs_of(spark, rows), {}, collocations.durable
    monkeypatch.setattr(collocations, "durable", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().toString()), durable(df, name))[1])
    monkeypatch.setattr(collocations, "RANGE_TEXT", 1 << 13)
    few, many = (sorted(map(tuple, collocations.frequent(docs, chunk_bytes=2000, known_slots=n).collect()), key=str) for n in (4_000_000, 0))
    assert few == many and len(few) > 100
    assert "Join" not in plans["phrase-hits"]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, "en"), (2, "a b", None)])).count() == 0
    few = docs_of(spark, [(1, "a b, a b", "en")])
    assert [tuple(r) for r in collocations.collocations(few, least=2).collect()] == [("en", 1, "a b", 2, 2, 2, 4, 1_000_000)]


def test_top_and_ties(spark):
    rows = [(i, "b c. a d. é f. z y", "en") for i in range(30)]
    got = collocations.collocations(docs_of(spark, rows), top=3).collect()
    assert [(r["rank"], r["phrase"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "a d"), (2, "b c"), (3, "z y")]


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    for row in range(collocations.ROWS):
        at = collocations.slots(grams, row, 5)
        assert at.max() < 5 << collocations.RANGE_BITS
        assert len(np.unique(at >> np.uint64(collocations.RANGE_BITS))) == 5
        assert (at == collocations.slots(grams, row, 5)).all()
    lists = [(r, p, collocations.pack_sorted(np.unique(collocations.unpack_sorted(x)))) for r, p, x in collocations._lists([grams[:1000]], 5)]
    reached = collocations.Reached(lists, 5)
    assert set(range(1000)) <= set(reached.holds(grams).tolist()) and len(reached.holds(grams)) < 1100


# ---------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<double>, label int, codes string, n int"


def codes_brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for step in range(rounds + 1):
        found = [[near(v[p * w : p * w + w], books[p]) for p in range(parts)] for _, v, _ in kept]
        if step < rounds:
            for p in range(parts):
                groups = defaultdict(list)
                for (_, v, _), f in zip(kept, found):
                    groups[f[p][1]].append(v[p * w : p * w + w])
                for j, members in groups.items():
                    books[p][j] = [sum(c) // len(members) for c in zip(*members)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = Counter()
    for (_, _, label), f in zip(kept, found):
        by_label[label] += sum(d for d, _ in f)
    return [(i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), by_label[label], digest) for (i, _, label), f in zip(kept, found)]


def vectors_of(rng, n, d, scale=1.0):
    centres = rng.normal(size=(20, d))
    return [(int(rng.integers(0, 10 * n)), (scale * (centres[int(rng.integers(20))] + 0.2 * rng.normal(size=d))).tolist(), [None, 0, 1, 2][int(rng.integers(4))]) for _ in range(n)]


@pytest.mark.parametrize("n,d,scale", [(700, 8, 1.0), (40, 8, 1.0), (300, 16, 1e6), (300, 4, 1e-3)])
def test_codes(spark, n, d, scale):
    rng = np.random.default_rng(n)
    rows = vectors_of(rng, n, d, scale)
    rows += [rows[0]] * 3 + [(1, None, 1), (2, [math.nan] + [0.0] * (d - 1), 1), (3, [math.inf] * d, 2), (4, [None] + [1.0] * (d - 1), 0), (5, [0.0] * d, None), (None, [-0.5] * d, 7)]
    got = vector_codes.compress(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, codes_brute(rows)))


def test_codes_of_nothing(spark):
    make = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    assert vector_codes.compress(make([])).count() == 0
    assert vector_codes.compress(make([(1, None, 1)])).count() == 0
    assert [r["code"] for r in vector_codes.compress(make([(1, [], 1)])).collect()] == ["00000000"]
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 3, 1)]):
        with pytest.raises(ValueError, match="one length"):
            vector_codes.compress(make(rows))


@pytest.mark.parametrize("high", [40, 1 << 30, 1 << 39])
def test_search_is_exact(high):
    rng = np.random.default_rng(high)
    entries = rng.integers(-high, high, (60, 5))
    entries[7] = entries[3]  # ties between equal entries, too
    x = rng.integers(-high, high, (400, 5))
    x[:60] = entries
    book = vector_codes.Codebook(entries)
    entry, far, looked = book.nearest(x, rng.integers(0, 60, 400))
    for i in range(400):
        want = min((sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], e)), j) for j, e in enumerate(entries))
        assert (int(far[i]), int(entry[i])) == want
    again = book.nearest(x, entry)
    assert (again[0] == entry).all() and again[2] < looked


def test_search_prunes():
    rng = np.random.default_rng(0)
    centres = rng.integers(-5000, 5000, (256, 16))
    x = centres[rng.integers(0, 256, 5000)] + rng.integers(-50, 50, (5000, 16))
    entry, _, _ = vector_codes.Codebook(centres).nearest(x, np.zeros(5000, int))
    assert vector_codes.Codebook(centres).nearest(x, entry)[2] < 0.1 * 256 * 5000


def test_registered():
    from scriptorium.llm import queries

    for name in ("op11_quality_rules", "op12_collocations", "op13_vector_codes"):
        assert name in queries.queries() and name in queries.oracle_sql()
