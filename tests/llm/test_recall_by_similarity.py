"""The near-duplicate stage finds nine of ten pairs in every band of similarity from 0.8 up, and leaves unlike texts alone."""

import numpy as np

from rowloom.llm import simhash


def similar(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_nine_of_ten_in_every_band(spark):
    rng = np.random.default_rng(11)
    words = np.array([f"w{k}" for k in range(20_000)])
    rows, truth = [], []
    for k in range(3000):
        n = int(rng.integers(80, 500))
        a = list(rng.choice(words, n))
        b = list(a)
        for i in rng.choice(n, max(1, int(n * rng.uniform(0.002, 0.06))), replace=False):
            b[i] = str(rng.choice(words))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        truth.append(similar(a, b))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(2 * k in kept for k in range(3000))
    dropped, truth = np.array([2 * k + 1 not in kept for k in range(3000)]), np.array(truth)
    bands = [(0.95, 1.0), (0.9, 0.95), (0.85, 0.9), (0.8, 0.85), (0.75, 0.8), (0.7, 0.75), (0.65, 0.7), (0.6, 0.65), (0.0, 0.6)]
    found = {b: (round(float(dropped[(truth >= b[0]) & (truth < b[1])].mean()), 3), int(((truth >= b[0]) & (truth < b[1])).sum())) for b in bands}
    print(found)
    assert all(found[b][0] >= 0.9 and found[b][1] > 100 for b in bands[:4]) and found[0.6, 0.65][0] < 0.25


def test_repeated_lines_do_not_stand_for_a_text(spark):
    """Texts that share one line a hundred times and nothing else are unlike: shingles count once."""
    rng = np.random.default_rng(12)
    line = " ".join(f"l{k}" for k in range(12))
    rows = [(d, " ".join([line] * 100 + [f"w{v}" for v in rng.integers(0, 9999, 150)])) for d in range(12)]
    assert simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 12
