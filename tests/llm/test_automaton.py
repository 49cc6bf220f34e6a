"""Suffix automata against direct search."""

import random

import pytest

from nimbara.llm import automaton as A


def longest(words, refs):
    runs = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    return [next((n for n in range(i + 1, 0, -1) if tuple(words[i + 1 - n : i + 1]) in runs), 0) for i in range(len(words))]


def test_matching_statistics():
    rng = random.Random(4)
    for _ in range(150):
        refs = [[rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(0, 4))]
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        got = A.SuffixAutomaton(refs).statistics(words)
        assert got == longest(words, refs)
        want = sorted({k for i, n in enumerate(got) if n >= 2 for k in range(i + 1 - n, i + 1)})
        assert [k for lo, hi in A.covered(got, 2) for k in range(lo, hi)] == want


def test_remove_reference(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD", 8)
    ref = spark.createDataFrame([("a b c d e",), ("x y z u v w",), (None,)], "text string")
    docs = spark.createDataFrame([(1, "q a b c d r"), (2, "x y  z"), (3, None), (4, "y z u v w a b c")], "doc_id int, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in A.remove_reference(docs, ref, size=3).collect()}
    assert got == {1: ("q r", 4), 2: ("", 3), 3: (None, 0), 4: ("", 8)}
    monkeypatch.setattr(A, "MOST", 5)
    with pytest.raises(ValueError):
        A.remove_reference(docs, ref, size=3)
