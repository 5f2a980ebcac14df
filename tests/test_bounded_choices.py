"""Choices of groups and balanced cells against plain versions, at any size."""

import hashlib
import itertools
import math
import random

from pyspark.sql import functions as F

from rowloom.operators import negatives, splits


def _chosen(spark, sizes, fraction):
    rows = spark.createDataFrame(list(sizes.items()), "g string, n long").select("g", F.explode(F.sequence(F.lit(1), F.col("n"))))
    found = [r.g for r in splits.group_validation(rows, "g", fraction).collect()]
    assert len(found) == len(set(found))
    return sorted(found)


def test_groups_sum_nearest(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {f"g{k}": rng.randint(1, 30) for k in range(rng.randint(2, 9))}
        fraction = rng.choice([0.1, 0.25, 0.5])
        target = max(1, math.ceil(sum(sizes.values()) * fraction))
        sums = {sum(c) for r in range(1, len(sizes)) for c in itertools.combinations(sizes.values(), r)}
        assert sum(sizes[g] for g in _chosen(spark, sizes, fraction)) == min(sums, key=lambda s: (abs(s - target), s))


def test_little_is_left_open(spark, monkeypatch):
    """Most groups come by hash order, one of a third of all rows stays out, and the rows are the very number."""
    rng = random.Random(4)
    sizes = {f"g{k}": rng.randint(2, 9) for k in range(2000)}
    sizes["hot"] = sum(sizes.values()) // 2
    monkeypatch.setattr(splits, "FIRST_ROOM", 32)
    monkeypatch.setattr(splits, "MOST_ROOM", 32)
    chosen = _chosen(spark, sizes, 0.1)
    assert sum(sizes[g] for g in chosen) == math.ceil(sum(sizes.values()) * 0.1) and "hot" not in chosen
    ones = {k for k in chosen if sizes[k] == 2}
    assert 0.05 < len(ones) / sum(n == 2 for n in sizes.values()) < 0.3  # a draw over all sizes, not the small ones first
    even = {f"g{k}": 40 + 2 * (k % 3) for k in range(90)}  # each has more than what is left open
    assert abs(sum(even[g] for g in _chosen(spark, even, 0.11)) - sum(even.values()) * 0.11) <= 20


def test_pairs_as_one_by_one(spark):
    rng = random.Random(6)
    names = [(p, m, f"g{k}") for p in ("hot", "b", "c", "d", "e") for m in "xy" for k in range(60 if p == "hot" else rng.randint(1, 6))]
    peers = [[k for k in names if rng.random() < share] for share in (0.9, 0.5, 0.1)]
    quotas = {p: rng.randint(0, 3) if p != "hot" else 70 for p in "hot b c d e".split()}
    want = set()
    for p, quota in quotas.items():
        left = [sum(k[0] == p for k in peer) for peer in peers]
        mine = [(k, [i for i, peer in enumerate(peers) if k in peer]) for k in names if k[0] == p]
        mine = sorted((x for x in mine if x[1]), key=lambda x: (-len(x[1]), hashlib.md5("|".join(("42", *x[0])).encode()).hexdigest()))
        n = 0
        for k, of in mine:
            if n < quota and all(left[i] > 1 for i in of):
                want.add(k)
                n += 1
                for i in of:
                    left[i] -= 1
    make = lambda rows: spark.createDataFrame(rows, "pep string, mhc string, grp string")
    got = splits.pair_validation(make(names), spark.createDataFrame(list(quotas.items()), "pep string, quota long"), [make(p + p[:3]) for p in peers])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_few_groups(spark):
    assert _chosen(spark, {"a": 5}, 0.5) == [] and _chosen(spark, {"a": 5, "b": 5}, 0.1) in (["a"], ["b"])
    assert _chosen(spark, {"a": 90, "b": 7}, 0.1) == ["b"]
    rows = spark.createDataFrame([(None,)] * 9 + [("a",), ("b",)], "g string")
    assert len(splits.group_validation(rows, "g", 0.5).collect()) == 1
    assert splits.group_validation(rows.limit(0), "g", 0.5).collect() == []


def test_folds_as_one_by_one(spark):
    rng = random.Random(5)
    for folds in (1, 3, 5):
        sizes = {f"g{k}": rng.choice([1, 1, 2, 3, 3, 8, 40, 500]) for k in range(200)}
        load, want = [0] * folds, {}
        for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            k = min(range(folds), key=lambda i: (load[i], i))
            want[name], load[k] = k, load[k] + n
        got = splits.group_folds(spark.createDataFrame(list(sizes.items()), "brand string, n long").repartition(5), folds)
        assert {r.brand: r.fold for r in got.collect()} == want
    assert splits.group_folds(spark.createDataFrame([], "brand string, n long"), 3).count() == 0


def test_balanced_cells(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 1), k) for k in range(3000)] + [("c", 1, 3000 + k) for k in range(200)]
    df = spark.createDataFrame(rows, "cell string, label int, k long")
    got = negatives.balanced(df, ["cell"], ["k"])
    counts = {r.cell: r["count"] for r in got.groupBy("cell").count().collect()}
    assert set(counts.values()) == {200} and len(counts) == 4 and got.columns == df.columns
    import hashlib

    order = lambda r: (hashlib.md5(f"42|{r[2]}".encode()).hexdigest(), r[2])
    want = {x for c in ("a", "b", "c", None) for x in sorted((r for r in rows if r[0] == c), key=order)[:200]}
    assert {tuple(r) for r in got.collect()} == want
    assert negatives.balanced(df.where(F.lit(False)), ["cell"], ["k"]).count() == 0
