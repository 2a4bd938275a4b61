import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, hello world. It's a TEST... x", None, "", "   ", "a" * 5000, "Ωmega ΣΑΣ İstanbul don't 'll 's", "日本語 テスト、はい。", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "é é  nbsp em \x1cfs", "word " * 9000, "1,234.50 ab.,.", "퟿\U0001f600 ok"
]


def plain(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_matches_tokenizer():
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(PATH).encode(TEXTS)]
    assert got == [plain(t) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    got = next(packing.encoder_of(PATH, 2).encode([text]))
    assert np.frombuffer(got, "<u4").tolist() == plain(text)


def test_memory_changes_no_ids():
    encoder = packing.WordEncoder(PATH, memory_words=3)
    for text in TEXTS * 2:
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == plain(text)
        assert len(encoder.known) <= 3 + 3 * len(set((text or "").lower().split()))


def test_encoder_other_kinds():
    path = public_tokenizers.path("byte_bpe_50k.json")
    # Its words keep their leading space: not a tokenizer for this encoder, but single words agree.
    got = next(packing.WordEncoder(path, None).encode(["word"]))
    assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(path).encode("word").ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4096), min_size=1, max_size=60))
def test_differencing(sizes):
    windows = packing.near_equal(sizes, 4096)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in w) for w in windows) <= 4096


def test_differencing_is_near_equal():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 900, 400).tolist()
    at = packing.difference(sizes, 40)
    sums = np.bincount(at, weights=sizes, minlength=40)
    assert sums.max() - sums.min() <= 20
    assert sorted(np.bincount(packing.difference([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]  # the method's known answer


def check(spark, rows, schema="doc_id long, text string", parts=2):
    docs = spark.createDataFrame(rows, schema)
    got = packing.pack(docs.repartition(parts), PATH).toPandas()
    for doc, g in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        want = [plain(t) for d, t, *_ in rows if d == doc]
        assert set(g.doc_tokens) == {len(x) for x in want}
        if len(want) == 1:
            ids = np.concatenate([np.frombuffer(x, "<u4") for x in g.ids]).tolist()
            assert ids == want[0] and (g.start.values == np.r_[0, g.length.cumsum().values[:-1]]).all()
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.values == np.r_[0, g.length.cumsum().values[:-1]]).all() and g.length.sum() <= 4096
    assert got.length.sum() == sum(len(plain(t)) for _, t, *_ in rows)
    return got


def test_pack(spark):
    check(spark, [(i, t) for i, t in enumerate(TEXTS)])
    check(spark, [(i, "the and of " * (i * 37 % 900)) for i in range(80)], parts=3)


def test_the_differenced_windows_are_the_sequences(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "the " * int(n)) for i, n in enumerate(rng.integers(1, 700, 600))]
    got = check(spark, rows, parts=1)
    sizes = got.sort_values("doc_id").length.tolist()  # no document is cut
    assert len(got) == len(rows)
    sums = got.groupby("sequence_id").length.sum()
    want = packing.near_equal(sizes, 4096)
    assert sorted(sums) == sorted(sum(sizes[i] for i in w) for w in want)
    assert len(sums) <= -(-sum(sizes) // 4096) + 1 and sums.max() - sums.min() <= 20


def test_long_texts(spark):
    check(spark, [(1, "word another " * 60_000), (2, "x"), (3, "a" * 300_000), (4, None)], parts=1)


def test_edges(spark):
    assert check(spark, [(1, "same"), (1, "same")]).length.sum() == 4  # repeated rows are packed each for itself
    docs = spark.createDataFrame([(1, "x", "clash", b"y")], "doc_id long, text string, sequence_id string, ids binary")
    assert packing.pack(docs, PATH).first()["sequence_id"] % (1 << 40) == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "x")], "doc_id long, text string"), PATH).first()["doc_id"] is None
    assert packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH, end_id=None).count() == 0


def test_query(spark, data):
    from scriptorium.llm import queries

    got = queries.queries()["op1_packing"](spark, data).toPandas()
    docs = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert set(got.doc_id) == set(docs)
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 4096 and 4096 * len(sums) - sums.sum() <= 0.05 * sums.sum()
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.asarray(docs[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(docs[r.doc_id])


def test_workers_keep_one_operator(monkeypatch):
    from scriptorium.llm import workers

    monkeypatch.setattr(workers, "_kept", {})
    first = packing.encoder_of(PATH, 2)
    assert packing.encoder_of(PATH, 2) is first
    packing.encoder_of(PATH, None)
    assert packing.encoder_of(PATH, 2) is not first
    workers.forget()
    assert not workers._kept


def test_columns_encode_as_texts():
    """Distinct words looked up once and ids gathered give what the tokenizer gives for each text."""
    import random

    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(4)
    texts = ["", None, " ", "<|endoftext|> X", "A.B., c,.", "日本語 テスト", ".,", "ﬁ ß İ I", "tab\tx\x0by\x0cz\r\n"] + ["".join(rng.choices("aAbB .,é%|<>&日\n\t-'1", k=rng.randint(0, 60))) for _ in range(300)]
    for memory in (packing.MEMORY_WORDS, 40):
        encoder = packing.WordEncoder(path, memory_words=memory)
        got = list(encoder.encode_column(pa.array(texts, pa.string())))
        assert got == list(packing.WordEncoder(path).encode(texts))
        assert all(np.frombuffer(x, "<u4").tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for x, t in zip(got, texts))


def test_differencing_of_dense_partitions():
    """Windows that are all in use are merged from both ends."""
    assert sorted(np_sums([8, 7, 6, 5, 4], 2)) == [14, 16]
    for sizes, windows in (([9] * 10, 3), ([5, 5, 5], 3), ([1], 4), (list(range(1, 40)), 5)):
        sums = np_sums(sizes, windows)
        assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= max(sizes)


def np_sums(sizes, windows):
    import numpy as np

    return np.bincount(packing.difference(sizes, windows), weights=sizes, minlength=windows).astype(int).tolist()
