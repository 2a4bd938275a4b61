"""Word hashing and the pieces of the operators that need no session."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import words as wd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=" \t\n\x0b\x0c\r\x1c\xa0abAé中", max_size=30), max_size=6))
def test_words_are_the_pattern(texts):
    got, names = [], {}
    for w in wd.words(pa.array(texts, pa.string())):
        for i in range(len(w.at) - 1):
            spans = [bytes(w.data[w.starts[j] : w.ends[j]]).decode() for j in range(w.at[i], w.at[i + 1])]
            got.append(spans)
            for s, h in zip(spans, w.hashes[w.at[i] : w.at[i + 1]].tolist()):
                assert names.setdefault(s, h) == h
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(set(names.values())) == len(names)


def test_slices_do_not_matter(monkeypatch):
    texts = ["a b " * 50, None, "", "c" * 300, "a b"]
    whole = np.concatenate([w.hashes for w in wd.words(pa.array(texts))])
    monkeypatch.setattr(wd, "SLICE_BYTES", 64)
    parts = list(wd.words(pa.array(texts)))
    assert len(parts) > 1 and (np.concatenate([w.hashes for w in parts]) == whole).all()
    sliced = list(wd.words(pa.array(["zz", *texts]).slice(1)))
    assert (np.concatenate([w.hashes for w in sliced]) == whole).all()


def test_lower_case_is_ascii_only():
    h = lambda t, lower: next(wd.words(pa.array([t]), lower)).hashes.tolist()
    assert h("ABZ É", True) == h("abz É", True) != h("abz é", True) and h("AB", False) != h("ab", False)


def test_grams():
    h = np.arange(1, 9, dtype=np.uint64)
    g = wd.grams(np.concatenate([h, h]), 3)
    assert len(g) == 14 and (g[:6] == g[8:]).all() and len(set(g[:6].tolist())) == 6
    assert len(wd.grams(h, 9)) == 0
