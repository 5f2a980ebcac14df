"""Nearest strings beyond the segment rounds, negatives of awkward pools, and the checkpoint rule."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import negatives, neighbors
from rowloom.operators.components import checkpoint_dir


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_far_strings_against_all_pairs(spark):
    rng = random.Random(3)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    queries = {text("abc", rng.randint(0, 60)) for _ in range(25)} | {"q" * 90, ""}
    pool = {text("xyzab", rng.randint(1, 50)) for _ in range(60)}
    frame = lambda x: spark.createDataFrame([(t,) for t in sorted(x)], "s string")
    got = {r.s: (r.min_edit_distance, r.nearest, r.nearest_ties) for r in neighbors.nearest_strings(frame(queries), frame(pool), "s").collect()}
    for q in queries:
        far = [(levenshtein(q, p), p) for p in pool]
        least = min(far)[0]
        assert got[q] == (least, min(far)[1], sum(d == least for d, _ in far))


def test_ranked_negatives_of_small_pools(spark):
    blocked = spark.createDataFrame([("p", "CA/B"), ("p", "D/E"), ("q", "none/none")], "pep string, ab string")
    pool = spark.createDataFrame([("A/B",), ("D/E",), ("G/H",), ("I/K",), (None,)], "ab string").dropna()
    want = spark.createDataFrame([("p", 5), ("q", 2), ("r", 0)], "pep string, wanted long")
    got = [(r.pep, r.ab) for r in negatives.ranked_negatives(want, pool, blocked, "wanted").collect()]
    assert sorted(x for p, x in got if p == "p") == ["G/H", "I/K"]  # A/B shares its group with CA/B
    assert len({x for p, x in got if p == "q"}) == 2 and not [1 for p, _ in got if p == "r"]
    assert negatives.ranked_negatives(want, pool.limit(0), blocked, "wanted").count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch, spark):
    class Session:
        class sparkContext:  # noqa: N801
            master = "yarn"
            _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isDefined": lambda o: False})()})()})()

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session)
    checkpoint_dir(spark)
    assert spark.range(3).checkpoint().agg(F.count("*")).first()[0] == 3
