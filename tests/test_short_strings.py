"""Deletion variants of short strings: exact pairs, clusters and neighbours, and few candidates for each true pair."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import neighbors


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[:], i + 1
        for j, y in enumerate(b):
            row[j + 1] = min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_pairs_are_exact_at_all_lengths(spark, k):
    draw = random.Random(k)
    word = lambda n: "".join(draw.choice("ab" if draw.random() < 0.5 else "abcdefgh") for _ in range(n))
    texts = ["", "a", "aa", *(word(draw.choice([1, 2, 3, 5, 9, 12, 17, 18, 19, 24, 25, 30])) for _ in range(120))]
    for t in texts[:60]:  # near copies across the border of the two kinds of keys
        s = list(t)
        for _ in range(k):
            at = draw.randrange(len(s) + 1)
            s[at : at + draw.randrange(2)] = draw.choice(["", "x", "a"])
        texts.append("".join(s))
    texts = sorted(set(texts))
    got = {(r.a, r.b): r.d for r in neighbors.bounded_self_join(spark.createDataFrame([(t,) for t in [*texts, None, *texts[:5]]], "t string"), "t", k).collect()}
    want = {(x, y): distance(x, y) for i, x in enumerate(texts) for y in texts[i + 1 :] if abs(len(x) - len(y)) <= k and distance(x, y) <= k}
    assert got == want and len(want) > 50


def test_lengths_that_meet_by_variants():
    assert [neighbors.short_length(k) for k in (1, 2, 3, 4)] == [11, 17, 23, 15] and neighbors.short_length(8) == 11


@pytest.mark.parametrize("k, most", [(1, 1.5), (2, 3.0)])
def test_few_candidates_for_each_true_pair(spark, k, most):
    """20,000 random strings of nine letters and 20,000 near copies of them."""
    draw = random.Random(9)
    residues = "ACDEFGHIKLMNPQRSTVWY"
    texts = ["".join(draw.choices(residues, k=9)) for _ in range(20_000)]
    for t in texts[:20_000]:
        at = draw.randrange(9)
        texts.append(t[:at] + draw.choice(residues) + t[at + 1 :])
    df = spark.createDataFrame([(t,) for t in set(texts)], "a string")
    met = neighbors.candidates(df, df.withColumnRenamed("a", "b"), k).where("a < b").distinct()
    row = met.agg(F.count("*").alias("n"), F.count_if(F.levenshtein("a", "b", k) >= 0).alias("linked")).first()
    assert row.linked >= 18_000 and row.n <= most * row.linked, row


def test_dense_groups_have_few_edges(spark):
    """1,500 strings of one cluster: a star's edges, not a million pairs; clusters as by brute force."""
    draw = random.Random(3)
    dense = {"ACDEFGHIK"[:i] + draw.choice("LMNPQRSTVWY") + "ACDEFGHIK"[i + 1 :] for i in range(9) for _ in range(60)}
    others = {"".join(draw.choices("ACDEF", k=draw.choice([4, 9, 20, 26]))) for _ in range(150)}
    texts = sorted(dense | others)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for k in (1, 2):
        edges = neighbors.linking_edges(df, "t", k).collect()
        assert all(distance(r.a, r.b) <= k for r in edges)
        parent = {t: t for t in texts}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in ((r.a, r.b) for r in edges):
            parent[max(root(x), root(y))] = min(root(x), root(y))
        mine = {t: root(t) for t in texts}
        pairs = [(x, y) for i, x in enumerate(texts) for y in texts[i + 1 :] if abs(len(x) - len(y)) <= k and distance(x, y) <= k]
        assert all(mine[x] == mine[y] for x, y in pairs)
        if k == 2:
            assert len(edges) < len(pairs) / 2
