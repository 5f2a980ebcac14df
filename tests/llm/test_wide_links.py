"""The near-duplicate stage: five words, similarity 0.8, clashing names, and recall by similarity."""

import numpy as np
from pyspark.sql import functions as F

from rowloom.llm import simhash


def similar(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_clashing_names_come_through(spark):
    rows = [(k, f"some words that are the same in both of them and so on {k // 2}", "x", 7, 9, "s", 1, None, "n") for k in range(8)] + [(None, None, None, 1, 2, "t", 3, 4, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__kept` string, `__row` long, row long, id string, fp long, sketch long, node string")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted(map(str, map(tuple, out.collect())))
    assert set(got) <= {str(r) for r in rows} and len(got) >= 2
    assert simhash.near_duplicates(docs).count() == 9 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_recall_and_what_is_left_alone(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(20_000)])
    rows, truth = [], []
    for k in range(300):
        a = list(rng.choice(words, 300))
        b = list(a)
        for i in rng.choice(300, [1, 3, 6, 60][k % 4], replace=False):
            b[i] = str(rng.choice(words))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b).upper())]
        truth.append(similar(a, [x.lower() for x in b]))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(300))
    dropped, truth = np.array([2 * k + 1 not in kept for k in range(300)]), np.array(truth)
    share = lambda lo, hi: dropped[(truth >= lo) & (truth < hi)].mean()
    print([(lo, hi, share(lo, hi)) for lo, hi in ((0.95, 1), (0.9, 0.95), (0.8, 0.9), (0, 0.5))])
    assert share(0.95, 1) > 0.95 and share(0.9, 0.95) > 0.7 and share(0.8, 0.9) > 0.25 and share(0, 0.5) == 0


def test_large_groups_of_near_copies(spark):
    rng = np.random.default_rng(6)
    base = [f"v{k}" for k in rng.integers(0, 9999, 400)]
    rows = []
    for k in range(3000):
        t = list(base)
        t[int(rng.integers(0, 400))] = f"u{k}"
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert [r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()] == [0]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(7)
    for share in (0.5, 0.8, 0.95):
        got = []
        for _ in range(300):
            both = rng.integers(0, 1 << 63, 1000, np.uint64)
            n = int(1000 * share)
            rest = rng.integers(0, 1 << 63, 1000 - n, np.uint64)
            cut = (1000 - n) // 2
            a, b = np.concatenate([both[:n], rest[:cut]]), np.concatenate([both[:n], rest[cut:]])
            got.append((simhash.text_sketch(a) ^ simhash.text_sketch(b)).bit_count())
        assert abs(np.mean(got) / 64 - (1 - share) / 2) < 0.02
