"""Whitening against whole-number arithmetic, extreme and ragged vectors, defined cases."""

import math
import random
from fractions import Fraction

import numpy as np

from residua.llm.queries import op12_digit_slice_whitening
from residua.llm.whitening import gram, limbs, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, x int, n int, component string"


def test_limbs_and_products_are_exact():
    rng = random.Random(1)
    for top, kind in ((1 << 8, np.int64), (1 << 40, np.int64), (1 << 60, np.int64), (1 << 90, object)):
        rows = [[rng.randint(-top, top) for _ in range(5)] for _ in range(70)] + [[top, -top, 0, 1, -1]]
        block = np.array(rows, kind)
        assert sum(np.vectorize(int, otypes=[object])(p) << (18 * k) for k, p in enumerate(limbs(block))).tolist() == rows
        assert gram(block).tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]


def brute(vectors, components=4):
    """(S, n, covariance as fractions) of the distinct floor(256 c)."""
    width = max((len(v) for v in vectors), default=0)
    xs = [tuple(min(max(math.floor(256 * c), -(1 << 63)), (1 << 63) - 1) for c in v) + (0,) * (width - len(v)) for v in vectors]
    fit = list(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3) for j in range(width)] for i in range(width)]
    return xs, fit, n, sums, cov


def check(spark, rows, tol=1e-8):
    got = whiten(spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], 0, 0, 0, "c") for i, v in rows], SCHEMA)).collect()
    good = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    xs, fit, n, sums, cov = brute([r[1] for r in good])
    values, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    k = min(4, len(sums))
    assert len(got) == k * len(good) and {r.n for r in got} == {n}
    want = sorted((r[0] is not None, r[0] or 0, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for r, x in zip(good, xs))
    assert sorted((r.vec_id is not None, r.vec_id or 0, int(r.deviation)) for r in got if r.component == 1) == want
    trace = float(sum(cov[i][i] for i in range(len(sums))))
    by = {(r.vec_id, int(r.deviation), r.component): r for r in got}
    for c in range(1, k + 1):
        e, axis = values[-c], axes[:, -c]
        ours = np.array([by[r[0], sum((n * a - s) ** 2 for a, s in zip(x, sums)), c].whitened for r, x in zip(good, xs)])
        plain = np.array([sum(float(Fraction(n * a - s, n)) * v for a, s, v in zip(x, sums, axis)) for x in xs]) / math.sqrt(e)
        assert min(np.abs(ours - plain).max(), np.abs(ours + plain).max()) < tol * max(1, np.abs(plain).max())
        assert all(abs(r.explained - e / trace) <= 1e-9 for r in got if r.component == c)
    assert all(r.identity_error < 1e-6 for r in got)


def vectors(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.linspace(1, 3, d)
    return (rng.normal(size=(n, d)) @ mix * scale).tolist()


def test_against_whole_numbers(spark):
    many = vectors(300, 6, 2)
    rows = [(i, v) for i, v in enumerate(many)] + [(900 + i, many[0]) for i in range(400)]  # one very common vector
    check(spark, [*rows, (1, None), (2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3, [1.0, math.inf, 0, 0, 0, 0.0]), (4, [math.nan] * 6), (None, many[5])])


def test_extreme_and_ragged_vectors(spark):
    check(spark, [(i, v) for i, v in enumerate(vectors(60, 5, 3, 1e13))])
    check(spark, [(i, v[: 3 + i % 3]) for i, v in enumerate(vectors(60, 5, 4))] + [(99, [])])
    check(spark, [(i, v) for i, v in enumerate(vectors(30, 2, 5))])


def test_degenerate_tables(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 0, 0, 0, ""), (2, [math.nan], 0, 0, 0, "")], SCHEMA)).count() == 0
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25], 0, 0, 0, ""), (1, [0.5, 0.25], 0, 0, 0, "")], SCHEMA)).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)] * 2
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 0, 0, 0, "") for i in range(9)], SCHEMA)).collect()
    assert {r.whitened for r in line if r.component == 2} == {0.0} and all(abs(r.explained - 1) < 1e-12 for r in line if r.component == 1)


def test_query(spark):
    got = op12_digit_slice_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert list(got.columns[:7]) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got["identity_error"].max() <= 1e-4 and got["identity_error"].nunique() == 1 and (got.groupby("component")["explained"].nunique() == 1).all()
    assert got.groupby("component")["whitened"].std(ddof=0).sub(1).abs().max() < 0.05 and str(got["deviation"].dtype) == "int64"
