"""Language id and the quality classifier against plain versions of the same models."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import langid, quality

MASK = (1 << 64) - 1


def bucket(gram, buckets):
    h = 0
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & MASK
    return ((((h * 0xD6E8FEB86659FD93) & MASK) ^ len(gram)) * 0xC2B2AE3D27D4EB4F & MASK) >> (64 - (buckets - 1).bit_length())


def grams(text, orders, buckets):
    padded = f" {text} "
    return [bucket(padded[i : i + n], buckets) for n in orders for i in range(len(padded) - n + 1)]


def test_language_id_is_plain_naive_bayes(spark):
    rng = random.Random(21)
    letters = {"aa": "abcdeé ", "bb": "bcdefß ", "cc": "aeiou中 "}
    make = lambda lang, n: "".join(rng.choice(letters[lang]) for _ in range(n))
    rows = [(i, make(lang, rng.randrange(1, 40)), lang) for i in range(150) for lang in [rng.choice(list(letters))]]
    rows += [(900, None, "aa"), (901, "no label", None), (902, "long text " * 40_000, "bb"), (902, "Same Id", "cc"), (902, "Same Id", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    names, matrix = langid.train(docs)
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        if t is not None and lang is not None:
            counts[lang].update(grams(t.lower(), langid.ORDERS, langid.BUCKETS))
    assert names == sorted(counts)
    total = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    log = lambda lang, b: math.log((counts[lang][b] + 0.5) / total[lang])
    asked = [*rows[:60], (1000, "É"), (1001, "abc " * 30_000), (1002, "12 34")]
    asked_docs = spark.createDataFrame([r[:2] for r in asked], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(asked_docs, names, matrix).collect()}
    assert langid.predict(asked_docs.limit(0), names, matrix).count() == 0
    for i, t, *_ in asked:
        sums = {lang: sum(n * log(lang, b) for b, n in Counter(grams(t.lower(), langid.ORDERS, langid.BUCKETS)).items()) for lang in names}
        best = max(sums.values())
        if not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
        elif sorted(sums.values())[-1] - sorted(sums.values())[-2] > 1e-2:
            assert got[i]["lang_pred"] == max(sums, key=sums.get)
            assert got[i]["score"] == pytest.approx(1 / sum(math.exp(s - best) for s in sums.values()), rel=1e-2)


def test_features_are_the_distinct_grams():
    texts = ["", "a", "abcabc", "Zwölf Ä", "x" * 500]
    flat, ends = quality.features(texts, 1 << 12, (2, 3))
    for k, t in enumerate(texts):
        assert flat[ends[k] : ends[k + 1]].tolist() == sorted(set(grams(t, (2, 3), 1 << 12)))


def test_dual_descent_finds_the_least_hinge_loss():
    """At the minimum of a convex function no step in any direction goes down."""
    rng = np.random.default_rng(22)
    rows, size = 80, 30
    dense = (rng.random((rows, size)) < 0.3).astype(float)
    y = np.where(dense[:, :5].sum(axis=1) + rng.normal(0, 0.7, rows) > 1.5, 1.0, -1.0)
    ratio = rng.normal(0, 1, size)
    flat = np.concatenate([np.flatnonzero(r) for r in dense]).astype(np.int32)
    lens = dense.sum(axis=1).astype(int)
    ends = np.concatenate([[0], np.cumsum(lens)])
    x = dense * ratio / np.sqrt(np.maximum(lens, 1))[:, None]
    for cost in (0.1, 1.0, 10.0):
        weighed, offset = quality.dual_descent(flat, ends[:-1], ends[1:], y, ratio, cost=cost, rounds=3000)
        w = weighed / ratio
        loss = lambda w, b, cost=cost: 0.5 * (w @ w + b * b) + cost * np.maximum(0, 1 - y * (x @ w + b)).sum()
        least = loss(w, offset)
        for step in (1e-1, 1e-2, 1e-3):
            for _ in range(300):
                assert loss(w + rng.normal(0, step, size), offset + rng.normal(0, step)) >= least - 1e-3 * least


def test_cost_is_chosen_without_the_held_out_rows(spark):
    rng = random.Random(23)
    rows = [(i, " ".join(rng.choice(["river", "flows", "the"] if (i % 2) ^ (rng.random() < 0.1) else ["BUY", "!!", "the"]) for _ in range(12))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (5, rows[5][1]), (400, "long text " * 50_000), (None, "x")], "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(i, (i + (flip and i >= 200)) % 2) for i in range(300)] + [(7, 0), (400, 1)], "doc_id long, quality int")
    one, two = (quality.train(docs, label(flip), F.col("doc_id") < 200) for flip in (False, True))
    assert (one.weights == two.weights).all() and one.offset == two.offset
    texts = [t for _, t in rows]
    flat, ends = quality.features(texts)
    y = np.where(np.arange(300) % 2 == 1, 1.0, -1.0)
    assert quality.chosen_cost(flat, ends, y, quality.BUCKETS) in quality.COSTS
    assert quality.chosen_cost(flat, ends, np.ones(300), quality.BUCKETS) == quality.COSTS[0]


def test_orders_are_chosen_by_what_folds_tell(spark):
    """The classes have the same letters, in another order."""
    rng = random.Random(24)
    words = lambda k: " ".join(rng.choice(["abc", "bca", "cab"] if k % 2 else ["cba", "acb", "bac"]) for _ in range(6))
    docs = spark.createDataFrame([(i, words(i)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True), orders=((1,), (3,)))
    assert model.orders == (3,)
    again = quality.train(docs.repartition(5), labels, F.lit(True), orders=((1,), (3,)))
    assert (again.weights == model.weights).all() and again.offset == model.offset


def test_more_languages_than_a_model_holds(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "aa"), ("b", "bb"), ("c", None)], "text string, lang string")
    monkeypatch.setattr(langid, "MODEL_BYTES", 4 * langid.BUCKETS * 2)
    assert langid.train(docs)[0] == ["aa", "bb"]
    monkeypatch.setattr(langid, "MODEL_BYTES", 4 * langid.BUCKETS)
    with pytest.raises(ValueError, match="2 languages"):
        langid.train(docs)


def test_sample_bounds_documents_and_bytes(spark, monkeypatch):
    """One id on very many documents, and long texts, don't grow what a fit takes."""
    taken = []
    before = quality.fit_features
    monkeypatch.setattr(quality, "fit_features", lambda flat, lens, *a: (taken.append(len(lens)), before(flat, lens, *a))[1])
    rows = [(1, f"good text {i}") for i in range(3000)] + [(2, f"bad words {i}") for i in range(10)] + [(1, "good text 1")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    quality.train(docs, labels, F.lit(True), sample=20, orders=((1, 2),))
    quality.train(docs, labels, F.lit(True), sample=5000, orders=((1, 2),))
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 100)
    quality.train(docs, labels, F.lit(True), sample=5000, orders=((1, 2),))
    # the first bound may leave one class only, of which nothing is fitted
    assert 3010 in taken and all(t in (3010, 20) or t < 15 for t in taken)
