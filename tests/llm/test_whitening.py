"""Whitening against numpy's own eigenvectors, the solver against matrices that are known."""

import math
from itertools import groupby

import numpy as np
import pytest

from loomframe.llm import whitening as W
from loomframe.llm.common import read
from tests.llm.helpers import SF

VECTORS = "vec_id long, embedding array<double>, x string, n string"


class Matrix:
    def __init__(self, a):
        self.a, self.products = a, 0

    def __matmul__(self, p):
        self.products += 1
        return self.a @ p


def plain(x):
    """(deviation, c, eigenvalues, eigenvectors) of whole-number vectors."""
    n, s = len(x), x.sum(0)
    c = (x - s // n).astype(float) - (s % n) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return [sum(int(v) ** 2 for v in row) for row in n * x.astype(object) - s.astype(object)], c, e[::-1], u[:, ::-1]


def whole(vectors):
    return np.array([[math.floor(64 * float(v)) + 1_000_000 for v in row] for row in vectors], np.int64)


@pytest.mark.parametrize("d, wanted", [(1, 32), (5, 32), (40, 32), (64, 32), (300, 32), (700, 6)])
def test_solver_to_double_precision(d, wanted):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.sort(rng.random(d) ** 3 * 100)[::-1]
    m = Matrix((a := (q * e) @ q.T) / 2 + a.T / 2)
    values, vectors = W.jacobi_davidson(m, d, wanted)
    assert np.abs(values - e[:wanted]).max() < 1e-11
    assert np.linalg.norm(m.a @ vectors - vectors * values, axis=0).max() < 1e-12 * math.sqrt(d) * e[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert m.products < 400


def test_solver_on_equal_and_missing_eigenvalues():
    values, vectors = W.jacobi_davidson(Matrix(np.diag([5.0, 5, 5, 2, 2] + [0.0] * 45)), 50, 8)
    assert np.abs(values[:5] - [5, 5, 5, 2, 2]).max() < 1e-13 and np.abs(values[5:]).max() < 1e-13
    assert np.abs(vectors[5:, :5]).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((9, 9))
    a, b = a + a.T, rng.standard_normal((9, 4))
    assert np.abs(a @ W.minres(lambda v: a @ v, b, 40, 1e-13) - b).max() < 1e-9


def test_whole_table(spark):
    table = read(spark, SF, "embeddings")
    rows = sorted(W.whiten(table).collect(), key=lambda r: (r.vec_id, r.component))
    given = sorted(table.collect(), key=lambda r: r.vec_id)
    x = whole([r.embedding for r in given])
    deviation, c, e, u = plain(x)
    want = c @ u[:, :32] / np.sqrt(e[:32])
    got = np.array([[r.whitened for r in g] for _, g in groupby(rows, key=lambda r: r.vec_id)])
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    assert np.abs(got.T @ got / len(x) - np.eye(32)).max() < 1e-10
    assert [r.deviation for r in rows[::32]] == deviation and [r.component for r in rows[:32]] == list(range(1, 33))
    assert {r.n for r in rows} == {len(x)} and max(r.identity_error for r in rows) < 1e-12
    assert np.abs([r.explained for r in rows[:32]] - e[:32] / e.sum()).max() < 1e-13


def test_rows_that_take_no_part_and_few_dimensions(spark):
    good = [(1, [0.5, 1.0]), (2, [1.5, -2.0]), (2, [1.5, -2.0]), (3, [0.25, 4.0])]
    bad = [(4, None), (5, []), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    rows = W.whiten(spark.createDataFrame([(i, v, "a", "b") for i, v in good + bad], VECTORS)).collect()
    deviation, c, e, u = plain(whole([v for _, v in good]))
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, k) for i in (1, 2) for k in ([1, 2] if i == 1 else [1, 1, 2, 2])] + [(3, 1), (3, 2)]
    assert {r.n for r in rows} == {4} and {(r.vec_id, r.deviation) for r in rows} == set(zip([1, 2, 2, 3], deviation))
    first = {r.vec_id: r.whitened for r in rows if r.component == 1}
    want = c @ u[:, 0] / math.sqrt(e[0])
    assert np.allclose([abs(first[i]) for i in (1, 2, 3)], np.abs(want[[0, 1, 3]]))


def test_directions_without_variance_are_left_out(spark):
    flat = [(i, [float(i % 5), 2.0, float(i % 5)], "", "") for i in range(40)]
    rows = W.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert len(rows) == 40 and {r.component for r in rows} == {1} and rows[0].explained == pytest.approx(1)
    for none in ([], [(1, [3.0, 4.0], "", "")], [(i, [1.0], "", "") for i in range(9)]):
        assert W.whiten(spark.createDataFrame(none, VECTORS)).collect() == []


def test_entries_of_any_size(spark):
    """The second direction is beyond double precision of the first."""
    rows = W.whiten(spark.createDataFrame([(i, [x, 1e9 * i], "", "") for i, x in enumerate([1e300, -1e300, 0.0, 5.0])], VECTORS)).collect()
    assert len(rows) == 4 and max(r.deviation for r in rows) == (1 << 63) - 1 and max(r.identity_error for r in rows) < 1e-6


def test_sums_that_meet_in_two_levels(spark, monkeypatch):
    table = read(spark, SF, "embeddings")
    want = {(r.vec_id, r.component): abs(r.whitened) for r in W.whiten(table).collect()}
    monkeypatch.setattr(W, "BLOCK", 16), monkeypatch.setattr(W, "PER_TASK", 1), monkeypatch.setattr(W, "MEET", 4)
    got = {(r.vec_id, r.component): abs(r.whitened) for r in W.whiten(table).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
