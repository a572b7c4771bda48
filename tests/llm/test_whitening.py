import math
from decimal import Decimal

import numpy as np
import pytest

from apexframe.llm import whitening


def plain(rows):
    """What the operator should return, by another eigensolver and Python's whole numbers."""
    own = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in own})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(dims)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = {}
    for i, x in own:
        projected = (np.array(x, float) - np.array([s / n for s in sums])) @ vectors
        for k in range(min(4, dims)):
            found[(i, k + 1)] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), projected[k] / math.sqrt(values[k]), values[k] / values.sum())
    return found


def test_against_another_solver(spark):
    rng = np.random.default_rng(4)
    made = rng.normal(size=(300, 12)) * np.linspace(2, 0.3, 12) + 0.7
    rows = [(k, [float(c) for c in np.float32(v)]) for k, v in enumerate(made)]
    rows += [(1000 + k, rows[3][1]) for k in range(150)]  # one vector holds a third of the rows
    rows += [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, []), (2000, rows[5][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string").repartition(5)
    found = whitening.whiten(df).collect()
    want = plain([(i, [None if c is None else float(np.float32(c)) for c in v] if v else v) for i, v in rows])
    assert len(found) == 4 * 451 and {(r.vec_id, r.component) for r in found} == set(want)
    signs = {}
    for r in sorted(found):
        n, deviation, value, explained = want[(r.vec_id, r.component)]
        assert r.n == n == 300 and r.deviation == deviation
        assert abs(r.explained - explained) < 1e-9 and 0 <= r.identity_error < 1e-9
        sign = signs.setdefault(r.component, math.copysign(1, r.whitened * value))
        assert abs(r.whitened - sign * value) < 1e-8


def test_components_of_hard_matrices():
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 40):
        basis, _ = np.linalg.qr(rng.normal(size=(size, size)))
        for values in (np.ones(size), np.arange(size), np.repeat([5.0, 1.0], size)[:size], 10.0 ** -np.linspace(0, 14, size), np.r_[1e6, np.full(size - 1, 1.0)], np.zeros(size), 1 + 1e-13 * np.arange(size)):
            a = basis * values @ basis.T
            found, vectors = whitening.components(a, min(4, size))
            scale = max(np.abs(values).max(), 1e-300)
            assert np.abs(found - np.sort(values)[::-1][:4]).max() <= 1e-13 * scale
            assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13
            assert np.linalg.norm(a @ vectors - vectors * found) <= 1e-12 * scale * size


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - vectors * np.sign(values) @ vectors.T).max() < 1e-12


def test_too_few_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    nothing = spark.createDataFrame([(1, None), (2, [])], schema)
    assert whitening.whiten(nothing).collect() == [] and whitening.whiten(nothing).columns[0] == "vec_id"
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.explained == 0 for r in one)
    # Two vectors lie on a line: one component has a variance.
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, -2.0])], schema)).collect()
    assert sorted((r.component, r.whitened is None) for r in two) == [(1, False)] * 2 + [(2, True)] * 2 + [(3, True)] * 2
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in two if r.component == 1)
    with pytest.raises(Exception, match="several lengths"):
        whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [1.0, 2.0])], schema))


def test_whole_numbers_beyond_64_bits():
    x = np.array([[2**40, -(2**41)], [0, 5]])
    sums = [2**40, 5 - 2**41]
    want = [sum((2 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert whitening._deviations(x, 2, sums) == want and want[0] > 2**63
    assert Decimal(want[0])  # fits the column's 38 digits
