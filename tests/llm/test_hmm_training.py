"""The hidden Markov model learns from all training documents, wherever they lie."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import hmm


def test_scores_do_not_depend_on_the_order_of_partitions(spark):
    rng = random.Random(15)
    text = lambda letter: " ".join(f"{letter}{3 * (i % 2) + rng.randrange(3)}" for i in range(rng.randrange(30, 60)))
    one, two = ([(first + i, text(letter)) for i in range(80)] for first, letter in ((0, "a"), (100, "b")))
    # Held-out documents alone in a partition: nothing is learnt from them, and they change nothing else.
    out = [(200 + 5 * i, text("c")) for i in range(80)]

    def scores(*parts):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(sum(parts, []), 3), "doc_id long, text string")
        return {r["doc_id"]: r["score"] for r in hmm.score(docs, F.col("doc_id") % 5 != 0, states=3, frequent=64).collect()}

    want = scores(one, two, out)
    for parts in ((two, one, out), (out, one, two)):
        assert scores(*parts) == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()}


def counts_by_hand(model, texts):
    """Expected counts by going through all state sequences of each text."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    total = 0.0
    for t in texts:
        paths = list(itertools.product(range(states), repeat=len(t)))
        p = np.array([model.start[z[0]] * np.prod([model.emit[x, s] for x, s in zip(t, z, strict=True)]) * np.prod([model.move[a, b] for a, b in itertools.pairwise(z)]) for z in paths])
        total += np.log10(p.sum())
        for z, share in zip(paths, p / p.sum(), strict=True):
            start[z[0]] += share
            for a, b in itertools.pairwise(z):
                move[a, b] += share
            for x, s in zip(t, z, strict=True):
                emit[x, s] += share
    return start, move, emit, total


@pytest.mark.parametrize("segment", [1, 2, 3, 5, 100])
def test_counts_of_texts_in_several_cuts(segment):
    rng = np.random.default_rng(16)
    start, move, emit = (x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(2), 0), (rng.random((2, 2)), 1), (rng.random((4, 2)), 0)))
    model = hmm.Hmm(start, move, emit)
    texts = [rng.integers(0, 4, n) for n in (1, 11, 2, 7, 3, 1, 10)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = counts_by_hand(model, texts)
    got = model.expected(np.concatenate(texts), first, segment)
    for a, b in zip(got, want, strict=False):
        assert np.allclose(a, b, rtol=1e-10)
    assert model.log10(np.concatenate(texts), first, segment).sum() == pytest.approx(want[3], rel=1e-12)


def test_only_inner_cuts_need_matrices(monkeypatch):
    """A text's first and last cut take one vector each: matrices of all cuts cost as much as the recursions."""
    rng = np.random.default_rng(17)
    model = hmm.Hmm.first(3, np.full(5, 0.2))
    asked = []
    through = hmm.Hmm._through
    monkeypatch.setattr(hmm.Hmm, "_through", staticmethod(lambda *a: asked.append((len(a[1]), a[-1].shape[1])) or through(*a)))
    sizes = [40, 7, 20, 8, 17]
    model.expected(rng.integers(0, 5, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)]), segment=10)
    assert sorted(asked) == [(2, 3), (3, 1), (3, 1)]


def test_rounds_take_several_chunks_at_a_time_and_lose_none(monkeypatch):
    monkeypatch.setattr(hmm, "TOGETHER", 5)
    rows = [(bytes([i] * n), bytes([n])) for i, n in enumerate([2, 3, 9, 1, 1])]
    assert list(hmm._together(iter(rows))) == [(b"\0\0\1\1\1", b"\2\3"), (b"\2" * 9, b"\11"), (b"\3\4", b"\1\1")]
    assert list(hmm._together(iter([]))) == []
