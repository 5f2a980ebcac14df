"""Whitening against numpy on whole numbers, merging in any order, and awkward vectors."""

from fractions import Fraction

import numpy as np
import pytest

from rowloom.llm import queries, whitening

SHAPE = "vec_id long, embedding array<float>"


def brute(x, top):
    """Covariance from exact fractions, eigenvectors from it."""
    n, d = x.shape
    sums = [sum(int(v) for v in x[:, j]) for j in range(d)]
    mean = [Fraction(s, n) for s in sums]
    c = np.array([[float(Fraction(int(v)) - m) for v, m in zip(r, mean, strict=True)] for r in x])
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    dev = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return dev, c @ v[:, :top] / np.sqrt(e[:top]), e / e.sum()


def test_query_agrees_with_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64) + 100_000
    dev, white, share = brute(x, 8)
    got = {(r.vec_id, r.component): r for r in queries.op13_whitening(spark, sf).collect()}
    assert len(got) == 8 * len(rows)
    ours = np.array([[got[r.vec_id, k].whitened for k in range(1, 9)] for r in rows])
    sign = np.sign((ours * white).sum(0))
    assert np.allclose(ours * sign, white, atol=1e-7)
    assert [got[r.vec_id, 1].deviation for r in rows] == dev
    assert np.allclose([got[rows[0].vec_id, k].explained for k in range(1, 9)], share[:8], rtol=1e-10)
    assert {r.n for r in got.values()} == {len(rows)} and {r.identity_error for r in got.values()} == {got[rows[0].vec_id, 1].identity_error}
    assert got[rows[0].vec_id, 1].identity_error < 1e-9


@pytest.mark.parametrize("cuts", [[7], [1, 2, 3], [50, 199], list(range(10, 200, 10))])
def test_merging_loses_nothing(cuts):
    rng = np.random.default_rng(len(cuts))
    x = rng.integers(-(1 << 45), 1 << 45, (200, 9)) // rng.integers(1, 1 << 30, 9)
    x[:, 4] = 12345
    state = None
    for part in np.split(x, cuts):
        one = whitening.State.of(part)
        again = whitening.State.read(*one.row().values())
        state = again if state is None else again.merged(state)
    assert state.n == 200 and state.sums == [sum(int(v) for v in x[:, j]) for j in range(9)]
    c = whitening.centred(x, state.n, state.sums)
    want = c.T @ c
    assert np.allclose(state.basis.T @ state.basis, want, rtol=1e-11, atol=1e-11 * np.abs(want).max())


def test_many_partitions(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(0, [1, 2, 3, 4, 5], (700, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], SHAPE).repartition(40)
    model = whitening.fit(df)
    x = np.floor(1024 * data.astype(np.float64)).astype(np.int64) + 100_000
    e = np.linalg.eigvalsh(np.cov((x - x.mean(0)).T, bias=True))[::-1]
    assert model.n == 700 and np.allclose(model.variances, e, rtol=1e-10)
    assert np.allclose(model.directions @ model.directions.T, np.eye(5), atol=1e-12)


def test_deviation_at_the_border_of_a_long():
    x = np.array([[0, 0], [1 << 31, 0], [1 << 49, 5]], np.int64)
    for n, sums in ((3, [sum(int(v) for v in x[:, j]) for j in range(2)]), (1, [0, 0]), (2, [-(1 << 31), 1 << 31])):
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
        model = whitening.Model(n, sums, np.eye(2), np.ones(2))
        assert model.deviation(x) == [w if w < 1 << 63 else None for w in want]


def rows_of(spark, rows, top=8):
    return whitening.whiten(spark.createDataFrame(rows, SHAPE), "vec_id", top).collect()


def test_awkward_vectors(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(20)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0]), (106, [1e30, 0.0, 0.0])]
    got = rows_of(spark, [*good, *bad, (None, [3.0, 2.0, 1.0]), good[0]])
    assert len(got) == 22 * 3 and {r.vec_id for r in got} == {*range(20), None} and {r.n for r in got} == {22}
    flat = [r for r in got if r.component == 3]
    assert {(r.whitened, r.explained) for r in flat} == {(0.0, 0.0)} and max(r.identity_error for r in got) < 1e-9
    assert rows_of(spark, bad[:4]) == [] and rows_of(spark, []) == []
    one = rows_of(spark, [(1, [1.0, 2.0])] * 2)
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(2, 0, 0.0, 0.0, 0.0)] * 4


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 5, 6) for i in range(4)], "vec_id long, embedding array<double>, n int, whitened int")
    assert {r.n for r in whitening.whiten(df, "vec_id", 1).collect()} == {4}
