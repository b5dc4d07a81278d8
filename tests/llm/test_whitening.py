"""Whitening against a dense eigenvalue solver, and the solver's steps on their own."""

from fractions import Fraction

import numpy as np
import pytest

from isoreach.llm import bidiagonal, registry, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all()


def check(df, given, components=4, scale=256):
    """Of (vec_id, vector, label), usable vectors of one length."""
    whole = [(i, tuple(int(np.floor(float(np.float32(c)) * scale)) for c in v)) for i, v, _ in given if usable(v)]
    x = np.array(sorted({v for _, v in whole}), np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(components, int((values > 1e-13 * values[0]).sum()))
    want = {}
    for i, v in whole:
        gap = [n * c - int(s) for c, s in zip(v, sums, strict=True)]
        want.setdefault((i, sum(g * g for g in gap)), []).append(np.array([g / n for g in gap]) @ axes[:, :count] / np.sqrt(values[:count]))
    got = df.collect()
    assert len(got) == len(whole) * count and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    assert by_row.keys() == want.keys()
    ours, theirs = [], []
    for key, rows in want.items():
        for k in range(len(rows)):
            ours.append([sorted(by_row[key][c + 1])[k] for c in range(count)])
            theirs.append(rows[0] if len(rows) > 1 else rows[k])
    ours, theirs = np.array(ours), np.array(theirs)
    single = [c for c in range(count) if min((abs(values[c] - values[o]) for o in range(len(values)) if o != c), default=1) > 1e-6 * values[0]]
    for c in single:
        sign = np.sign(ours[:, c] @ theirs[:, c])
        assert np.abs(ours[:, c] - sign * theirs[:, c]).max() < 1e-8
    listed = np.unique(np.column_stack([ours, np.array([list(k)[1] for k in want for _ in want[k]], float)]), axis=0)
    return ours, listed


def test_same_as_dense_solver(spark):
    rng = np.random.default_rng(1)
    turn = rng.normal(size=(10, 10)) * 0.7 ** np.arange(10)
    given = [(int(i), (rng.normal(size=10) @ turn + 3).astype(np.float32).tolist(), 0) for i in rng.permutation(600)]
    given += [(1000 + i, given[i][1], None) for i in range(200)]  # copies count once
    df = spark.createDataFrame(given, SCHEMA).repartition(40)
    check(whitening.whiten(df), given)


def test_unusable_repeats_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    given = [(i, rng.normal(size=3).astype(np.float32).tolist(), 0) for i in range(30)]
    given += [given[0], given[0], (None, [1.0, 2.0, 3.0], 0), (91, None, 0), (92, [nan] * 3, 0), (93, [1.0, inf, 0.0], 0), (94, [None] * 3, 0), (95, [], 0)]
    df = spark.createDataFrame([(*r, "n", 1.0) for r in given], f"{SCHEMA}, component string, x double")
    check(whitening.whiten(df), given)


def test_few_constant_and_empty(spark):
    make = lambda vectors: spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([[1.0, 2.0]] * 5)).count() == 0
    two = whitening.whiten(make([[1.0, 2.0], [3.0, 2.0], [3.0, 2.0]])).collect()
    assert sorted((r["component"], round(abs(r["whitened"]), 12)) for r in two) == [(1, 1.0)] * 3
    flat = [[float(i), 7.0, float(i * i % 7)] for i in range(9)]
    check(whitening.whiten(make(flat)), [(i, v, 0) for i, v in enumerate(flat)])
    with pytest.raises(OverflowError):
        whitening.whiten(make([[1e30, 1.0]]))


def test_equal_variances(spark):
    corners = [[float(s if k == j else 0) for k in range(6)] for j in range(6) for s in (-1, 1)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(corners)], SCHEMA)).collect()
    assert len(got) == 48 and got[0]["identity_error"] < 1e-12 and all(abs(r["explained"] - 1 / 6) < 1e-12 for r in got)


def test_deviation_beyond_64_bits(spark):
    given = [(i, [float(100_000 * (i % 50) + i), float(-i)], 0) for i in range(400)]
    given = [(i, [min(v[0], 400_000.0), v[1]], label) for i, v, label in given]
    check(whitening.whiten(spark.createDataFrame(given, SCHEMA)), given)


def triangles():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    yield np.linalg.qr(rng.normal(size=(500, 64)), mode="r")
    yield np.linalg.qr(rng.normal(size=(500, 30)) * 0.3 ** np.arange(30), mode="r")
    yield np.linalg.qr(rng.normal(size=(500, 30)) * 0.3 ** np.arange(30)[::-1], mode="r")
    yield np.linalg.qr(np.diag([5, 5, 5, 5, 2, 2, 1, 1, 1, 1, 1, 0.0]) @ turn, mode="r")
    yield np.linalg.qr(np.diag(5 - 1e-7 * np.arange(12)) @ turn, mode="r")
    yield np.diag([3.0, 0, 1, 2, 2])
    yield np.array([[2.0]])
    for _ in range(150):
        n = int(rng.integers(1, 12))
        yield np.triu(rng.integers(-2, 3, (n, n)).astype(float)) + 0.0


def test_solver():
    for r in triangles():
        if not r.any():
            continue
        diagonal, upper, right = bidiagonal.bidiagonal(r)
        values = bidiagonal.squares(diagonal, upper)
        want = np.linalg.svd(r, compute_uv=False)
        assert np.abs(np.sqrt(values) - want).max() <= 1e-13 * want[0] * len(r)
        count = min(4, int((values > 1e-20 * values[0]).sum()))
        axes = right @ bidiagonal.vectors(diagonal, upper, values[:count])
        assert np.abs(axes.T @ axes - np.eye(count)).max() < 1e-11
        assert np.linalg.norm(r.T @ (r @ axes) - axes * values[:count]) < 1e-11 * values[0]


def test_small_values_keep_their_digits():
    """dqds finds the least singular values of a graded bidiagonal matrix to full relative accuracy."""
    n = 12
    diagonal, upper = 10.0 ** -np.arange(n), 0.5 * 10.0 ** -np.arange(n - 1)
    got = bidiagonal.squares(diagonal, upper)
    exact = [Fraction(float(a)) for a in diagonal]
    determinant = Fraction(1)
    for a in exact:
        determinant *= a * a
    product = Fraction(1)
    for v in got:
        product *= Fraction(float(v))
    assert abs(product / determinant - 1) < Fraction(1, 10**12)


def test_query(spark, sf_dir):
    given = [tuple(r) for r in registry.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = registry.op13_whitening(spark, sf_dir)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check(got, given)
