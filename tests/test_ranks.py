"""Running sums, permutations, and draws from what is open, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom.functions import metrics
from rowloom.functions import sequences as S
from rowloom.operators import negatives, ranks


@pytest.mark.parametrize("seed", range(2))
def test_running_sums(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice([None, "a", "b", "hot", "hot", "hot"]), i, draw.randrange(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, at int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # groups lie in several parts
    try:
        got = {(r.g, r.at): (r.s, r.n) for r in ranks.running(df, ["g"], [F.desc("at")], {"s": F.col("v"), "n": F.lit(1)}).collect()}
        whole = {r.at: r.n for r in ranks.running(df, [], ["at"], {"n": F.lit(1)}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, counts = Counter(), Counter()
    for g, at, v in sorted(rows, key=lambda r: -r[1]):
        assert got[g, at] == (sums[g], counts[g])
        sums[g] += v
        counts[g] += 1
    assert whole == {i: i for i in range(3000)}
    assert ranks.running(df.limit(0), ["g"], ["at"], {"n": F.lit(1)}).collect() == []


def test_permutations(spark):
    sizes = [1, 2, 3, 5, 7, 16, 17, 99, 100, 101, 1000]
    df = spark.createDataFrame([(n, x, k) for n in sizes for x in range(n) for k in ("p", "q")], "n int, x int, k string")
    images = {}
    for r in df.select("n", "k", "x", ranks.permuted(F.col("x"), F.col("n"), F.lit(42), F.col("k")).alias("y")).collect():
        images.setdefault((r.n, r.k), {})[r.x] = r.y
    for (n, _), of in images.items():
        assert sorted(of.values()) == list(range(n))
    assert images[1000, "p"] != images[1000, "q"] and images[1000, "p"] != {i: i for i in range(1000)}


def test_images_are_spread_evenly(spark):
    """First images of 4,000 keys over 20 places: a chi-square of 19 degrees stays below its 0.1 % bound."""
    df = spark.range(4000).select(ranks.permuted(F.lit(0), F.lit(20), F.col("id")).alias("y")).groupBy("y").count()
    counts = [r["count"] for r in df.collect()]
    assert len(counts) == 20 and sum((c - 200) ** 2 / 200 for c in counts) < 43.8


def test_open_places(spark):
    segments = [("t", 0, 2), ("t", 2, 1), ("t", 5, 3), ("t", 9, 1), ("u", 7, 3)]
    blocked = {t: {p for s, lo, n in segments if s == t for p in range(lo, lo + n)} for t in "tuv"}
    draws = [(t, r) for t in "tuv" for r in range(10 - len(blocked[t]))]
    got = ranks.open_places(spark.createDataFrame(segments, "t string, lo long, len long"), spark.createDataFrame(draws, "t string, rank long"), ["t"])
    assert sorted((r.t, r["rank"], r.place) for r in got.collect()) == sorted((t, r, [p for p in range(10) if p not in blocked[t]][r]) for t, r in draws)
    assert {(r.t, r.open) for r in ranks.open_counts(spark.createDataFrame(segments, "t string, lo long, len long"), ["t"], 10).collect()} == {("t", 3), ("u", 7)}


def pairs(seed, peptides, donors):
    draw = random.Random(seed)
    pool = [f"C{draw.choice('ASQ')}{draw.choice('LMN')}{draw.choice(['', 'F'])}/C{draw.choice('AST')}{draw.choice(['W', 'FW', ''])}" for _ in range(donors)]
    return [(draw.choice([None, *(f"P{i}" for i in range(peptides))]), ab) for ab in pool for _ in range(2)]


def test_distinct_negatives(spark):
    known = pairs(3, 6, 60)
    df = spark.createDataFrame(known, "pep string, ab string")
    asked = sorted({(p, e) for p, _ in known for e in range(3)} | {("unseen", 0)}, key=repr)
    rows = spark.createDataFrame(asked, "pep string, epoch int")
    got = negatives.distinct_negatives(rows, df, df, times=5).collect()
    groups = {r.ab: r.g for r in df.select("ab", S.endpoint_group(F.col("ab")).alias("g")).distinct().collect()}
    by = {}
    for r in got:
        by.setdefault((r.pep, r.epoch), {})[r.draw] = r.ab
    for p, e in asked:
        own = {groups[ab] for q, ab in known if q == p}
        free = {ab for ab, g in groups.items() if g not in own}
        mine = by.get((p, e), {})
        assert len(mine) == len(set(mine.values())) == min(5, len(free)) and set(mine.values()) <= free
    alone = negatives.distinct_negatives(rows.where("epoch = 1"), df, df, times=5).collect()
    assert sorted(map(repr, alone)) == sorted(repr(r) for r in got if r.epoch == 1)
    assert len({tuple(sorted(v.items())) for v in by.values()}) > len(by) / 2  # draws of different rows differ
    assert negatives.distinct_negatives(rows, df.limit(0), df).collect() == []
    assert negatives.distinct_negatives(rows, df, df.limit(0), times=1).count() == len(asked)


@pytest.mark.parametrize("seed", range(2))
def test_other_target_negatives(spark, seed):
    draw = random.Random(seed)
    chain = lambda letter, n: letter + str(min(draw.randrange(n), draw.randrange(n), draw.randrange(n)))  # noqa: E731  some are common
    rows = [(f"t{draw.randrange(12)}", chain("a", 25), chain("b", 25 if seed else 200)) for _ in range(150)]
    rows += [("t0", "a1", "b0"), rows[0]]
    df = spark.createDataFrame(rows, "t string, a string, b string")
    got = negatives.other_target_negatives(df, "t", times=4).collect()
    by = {}
    for r in got:
        by.setdefault((r.t, r.a, r.b), set()).add((r.other_a, r.other_b))
        assert 0 <= r.draw < 4
    receptors = {(a, b) for _, a, b in rows}
    for t, a, b in set(rows):
        own_a, own_b = {x for s, x, _ in rows if s == t}, {y for s, _, y in rows if s == t}
        free = {(x, y) for x, y in receptors if x not in own_a and y not in own_b}
        mine = by.get((t, a, b), set())
        assert len(mine) == min(4, len(free)) and mine <= free
    assert len(got) == sum(map(len, by.values()))


def _plain_ranking(labels, scores):
    pos, neg = [s for y, s in zip(labels, scores, strict=True) if y], [s for y, s in zip(labels, scores, strict=True) if not y]
    if not pos or not neg:
        return None, None, None
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    ap = trap = rec0 = 0.0
    prec0 = 1.0
    for cut in sorted(set(scores), reverse=True):
        tp = sum(p >= cut for p in pos)
        prec, rec = tp / (tp + sum(q >= cut for q in neg)), tp / len(pos)
        ap, trap, prec0, rec0 = ap + (rec - rec0) * prec, trap + (rec - rec0) * (prec + prec0) / 2, prec, rec
    return auc, ap, trap


def test_ranking_over_several_parts(spark):
    """More distinct scores of one group than a part holds, ties, and groups of one label."""
    draw = random.Random(8)
    rows = [("hot", draw.randrange(2), draw.randrange(700) / 700) for _ in range(900)] + [(g, draw.randrange(2), draw.randrange(4) / 4) for g in "abc" for _ in range(9)]
    rows += [("one", 1, 0.3), ("one", 1, 0.2), (None, 0, 0.1), (None, 1, 0.1)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: tuple(r)[1:] for r in metrics.ranking(df, ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, own in ((g, [r for r in rows if r[0] == g]) for g in {r[0] for r in rows}):
        n, p, *three = got[g]
        assert (n, p) == (len(own), sum(r[1] for r in own))
        want = _plain_ranking([r[1] for r in own], [r[2] for r in own])
        assert three == [None] * 3 if want[0] is None else three == pytest.approx(want, abs=1e-12)
    assert metrics.ranking(df.limit(0), ["g"]).collect() == []


@pytest.mark.parametrize("scores", [[0.5], [1.0, 1.0, 1.0], [float("-inf"), 0.0, 3.0, float("inf")], [None, 2.0, 1.0, 1.0, 9.0, -4.0], [i * 0.37 % 5 for i in range(500)]])
def test_exact_quantiles(spark, scores):
    levels = [0.0, 0.02, 0.25, 0.5, 0.77, 1.0]
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    got = {r.level: r.value for r in metrics.quantiles(df, levels).collect()}
    known = sorted(s for s in scores if s is not None)
    for q in levels:
        at = q * (len(known) - 1)
        lo, hi = known[int(at)], known[-int(-at // 1)]
        assert got[q] == (lo if lo == hi else pytest.approx((1 - at % 1) * lo + at % 1 * hi, abs=1e-12))
    assert metrics.quantiles(df.limit(0), levels).collect() == []
