"""Candidates whose id repeats count once, by their best row, and hide no other neighbour."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import vptree


def brute(ids, x, q_id, q, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    best = {}
    for i, s in zip(ids.tolist(), (u @ (q / np.linalg.norm(q))).tolist(), strict=True):
        if i != q_id:
            best[i] = max(best.get(i, -2), s)
    return [i for i, _ in sorted(best.items(), key=lambda e: (-round(e[1], 9), e[0]))[:k]]


@pytest.mark.parametrize("rows", [10, 3000])
def test_shard_with_repeated_ids(rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(rows, 6))
    ids = rng.integers(1, max(8, rows // 6), rows)
    q = x[:4] + rng.normal(size=(4, 6)) * 0.01
    p, found, _ = vptree.Shard(ids, x).search(np.full(4, -1), q, np.full(4, 2.0), 5, 1.0)
    for n in range(4):
        assert found[p == n].tolist() == brute(ids, x, -1, q[n], 5)


def test_nearest_with_repeated_ids(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 8))
    ids = np.concatenate((np.arange(600), rng.integers(0, 600, 900)))
    for k in range(1, 4):  # one id six times beside each query
        x[600 + 6 * k : 606 + 6 * k] = x[100 * k] + rng.normal(size=(6, 8)) * 1e-3
        ids[600 + 6 * k : 606 + 6 * k] = 100 * k + 1
    keep = ~np.isin(ids, (0, 100, 200, 300)) | (np.arange(1500) < 600)
    x, ids = x[keep], ids[keep]
    df = spark.createDataFrame([(int(i), [float(e) for e in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(df, F.col("vec_id").isin(0, 100, 200, 300), shard_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: brute(ids, x, q, x[q], 5) for q in (0, 100, 200, 300)}
