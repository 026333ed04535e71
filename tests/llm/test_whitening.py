"""Whitening against numpy over whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from sluice.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, absent int, n string, component double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", 1, "n", 0.5) for i, v in rows], schema)


def plain(rows):
    """By place of the row: its x, and the fit's n, sums, covariance."""
    grid = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in rows]
    fit = sorted(set(grid))
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = [[Fraction(n * x[d] - sums[d], n) for d in range(dims)] for x in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dims)] for i in range(dims)])
    return grid, n, sums, cov


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [3, 1, 0.5, 2, 0.1] + 40).tolist()) for i in range(60)]
    rows += [(i + 100, rows[7][1]) for i in range(200)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), ((1 << 60) + 1, rows[3][1])]
    broken = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [math.nan] * 5), (904, [math.inf, 0.0, 0.0, 0.0, 0.0]), (905, [1e30, 0.0, 0.0, 0.0, 0.0])]
    got = whitening.whiten(frame(spark, rows + broken)).collect()
    grid, n, sums, cov = plain(rows)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    assert len(got) == 5 * len(rows) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    for (i, _), x in zip(rows, grid, strict=True):
        delta = [n * a - s for a, s in zip(x, sums, strict=True)]
        mine = by[i, sum(d * d for d in delta)]
        assert sorted(mine) == [1, 2, 3, 4, 5]
        for c, rs in mine.items():
            e, v = values[order[c - 1]], vectors[:, order[c - 1]]
            want = float(np.array(delta) / n @ v / math.sqrt(e))
            assert all(abs(abs(r["whitened"]) - abs(want)) < 1e-8 and abs(r["explained"] / (e / np.trace(cov)) - 1) < 1e-9 for r in rs)
    assert not {i for i, _ in broken} & {r["vec_id"] for r in got}


def test_signs_are_the_same_for_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    got = whitening.whiten(frame(spark, rows)).collect()
    grid, n, sums, cov = plain(rows)
    w = np.zeros((40, 3))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    fit = {x: k for k, x in enumerate(grid)}
    own = w[list(fit.values())]
    assert np.abs(own.T @ own / n - np.eye(3)).max() < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(frame(spark, rows)).collect() == []


def test_components_without_variance_are_left_out(spark):
    rows = [(1, [1.0, 5.0, 2.0]), (2, [2.0, 5.0, 4.0]), (3, [4.0, 5.0, 8.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 3 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12 and got[0]["identity_error"] < 1e-9


def test_at_most_sixteen(spark):
    rng = np.random.default_rng(1)
    got = whitening.whiten(frame(spark, [(i, rng.normal(size=20).tolist()) for i in range(50)])).collect()
    assert sorted({r["component"] for r in got}) == list(range(1, 17)) and len(got) == 800


def test_shorter_vectors_end_in_zeros(spark):
    full = [(1, [1.0, 0.0, 0.0]), (2, [0.5, 0.25, 0.0]), (3, [0.0, 1.0, 2.0]), (4, [2.0, 1.0, 0.5])]
    key = lambda rs: sorted((r["vec_id"], r["component"], r["deviation"], round(r["whitened"], 9)) for r in rs)
    cut = [(1, [1.0]), (2, [0.5, 0.25]), *full[2:]]
    assert key(whitening.whiten(frame(spark, cut)).collect()) == key(whitening.whiten(frame(spark, full)).collect())


def test_large_entries_stay_exact(spark):
    rows = [(1, [2.0**50, 1.0]), (2, [2.0**50 - 2**30, 3.0]), (3, [-(2.0**50), 2.0])]
    got = whitening.whiten(frame(spark, rows, SCHEMA.replace("array<float>", "array<double>"))).collect()
    assert {r["deviation"] for r in got} == {None} and {r["n"] for r in got} == {3}
    x = np.array([[1 << 40, 3], [5, 1 << 62]], np.int64)
    assert whitening.deltas(x, 3, [7, 9]).tolist() == [[3 * (1 << 40) - 7, 0], [8, 3 * (1 << 62) - 9]]
    assert whitening.deviations(np.array([[3, 4]])) == [25] and whitening.deviations(np.array([[1 << 40, 4]])) == [None]


def test_too_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_DIMS", 2)
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(frame(spark, [(1, [1.0, 2.0, 3.0])]))
