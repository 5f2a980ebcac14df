"""Evaluation negatives, draws within a domain, and recombination to a quota, against what they must hold; the law of group draws."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.operators import joins, negatives, ranks


def known_pairs(seed, n):
    draw = random.Random(seed)
    return [(f"P{draw.randrange(5)}", f"M{draw.randrange(2)}", f"C{draw.choice('ASQLMN')}{draw.choice('ASQLMN')}{draw.choice(['', 'F', 'FW'])}/CAS") for _ in range(n)]


def test_evaluation_negatives(spark):
    known = known_pairs(1, 60)
    df = spark.createDataFrame(known, "pep string, mhc string, ab string")
    groups = {r.ab: r.g for r in df.select("ab", S.endpoint_group(F.col("ab")).alias("g")).distinct().collect()}
    positives = df.where("pep < 'P4'").distinct()
    got = negatives.evaluation_negatives(positives, df, df, strict=False).collect()
    by = {}
    for r in got:
        assert groups[r.ab] == r.grp
        by.setdefault((r.pep, r.mhc), []).append((r.draw, r.grp))
    for key, n in Counter((p, m) for p, m, _ in set(known) if p < "P4").items():
        free = set(groups.values()) - {groups[ab] for p, _, ab in known if p == key[0]}
        mine = sorted(by.get(key, []))
        assert [d for d, _ in mine] == list(range(min(n, len(free)))) and len({g for _, g in mine}) == len(mine) and {g for _, g in mine} <= free
    with pytest.raises(ValueError, match="not enough negative groups"):
        negatives.evaluation_negatives(df, df.where("ab LIKE 'CA%'"), df)
    assert negatives.evaluation_negatives(df.limit(0), df, df).collect() == []


def test_groups_come_by_their_donors(spark):
    """3,000 keys draw one of two open groups, of nine and of one donor: the larger nine times in ten, all donors about alike."""
    pool = spark.createDataFrame([(f"CL{'F' * i}/CA",) for i in range(9)] + [("CM/CA",)], "ab string")
    positives = spark.range(3000).select(F.lit("P").alias("pep"), F.col("id").cast("string").alias("mhc"))
    got = Counter(r.ab for r in negatives.evaluation_negatives(positives, pool, pool.select(F.lit("P").alias("pep"), "ab").limit(0)).collect())
    assert len(got) == 10 and sum((n - 300) ** 2 / 300 for n in got.values()) < 27.9  # chi-square of 9, 0.1 %


def test_domains(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["d", "e", None]), p, ab) for p, _, ab in known_pairs(3, 80)]
    df = spark.createDataFrame(rows, "dom string, pep string, ab string")
    asked = df.select("dom", "pep", F.col("ab").alias("positive")).distinct()
    got = negatives.distinct_negatives(asked, df, df, times=2, within=["dom"]).collect()
    groups = {r.ab: r.g for r in df.select("ab", S.endpoint_group(F.col("ab")).alias("g")).distinct().collect()}
    by = Counter((r.dom, r.pep, r.positive) for r in got)
    for r in got:
        assert any(d == r.dom and ab == r.ab for d, _, ab in rows) and groups[r.ab] not in {groups[ab] for _, p, ab in rows if p == r.pep}
    for d, p, ab in set(rows):
        free = {x for e, _, x in rows if e == d} - {x for x in groups if groups[x] in {groups[y] for _, q, y in rows if q == p}}
        assert by[d, p, ab] == min(2, len(free))


def test_recombination_fills_its_quota(spark):
    draw = random.Random(5)
    rows = [(draw.choice("abc"), min(draw.randrange(40), draw.randrange(40))) for _ in range(200)] + [("a", None)]
    df = spark.createDataFrame(rows, "pep string, tcr int")
    for ratio in (0.1, 0.5, 5.0):
        got = negatives.recombined_to_quota(df, "pep", "tcr", ratio).collect()
        for p in "abc":
            mine = {r.tcr for r in got if r.pep == p}
            free = {t for _, t in rows if t is not None} - {t for q, t in rows if q == p}
            assert len(mine) == sum(r.pep == p for r in got) == min(round(sum(q == p for q, _ in rows) * ratio), len(free)) and mine <= free


def test_rights_come_by_their_rows(spark):
    """Of 300 lefts that draw one right each and know none, three in four draw the one with three in four rows."""
    df = spark.createDataFrame([(f"p{i}", 2 if i % 4 else 1) for i in range(300)], "pep string, tcr int")
    first = Counter(r.tcr for r in negatives.recombined_to_quota(df, "pep", "tcr", 1.0, df.limit(0)).collect())
    assert first[1] + first[2] == 300 and abs(first[2] - 225) < 30  # four deviations


def test_long_runs_are_cut_into_blocks(spark):
    df = spark.createDataFrame([("a", 0, 10), ("b", 5, 5), ("c", 3, 4)], "k string, lo long, hi long")
    got = sorted((r.k, r.i) for r in ranks.repeated(df, F.col("lo"), F.col("hi"), "i", block=4).collect())
    assert got == [("a", i) for i in range(10)] + [("c", 3)]


def test_shuffled_negatives_fall_back_to_repeats(spark):
    rows = [("full", r) for r in range(6)] + [("few", r) for r in (0, 1, 2, 3, 3, 3)] + [("many", 0)] * 2 + [("odd", None)]
    df = spark.createDataFrame(rows, "pep string, tcr int")
    got = negatives.shuffled_negatives(df, "pep", "tcr", 1.5).collect()
    of = lambda p: sorted(r.tcr for r in got if r.pep == p)
    assert of("full") == [] and len(of("few")) == 9 and set(of("few")) <= {4, 5}
    assert len(of("many")) == len(set(of("many"))) == 3 and 0 not in of("many") and len(of("odd")) == 1


def test_unobserved_counts(spark):
    every = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None), (None, 1)], "k string, g int")
    seen = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 9)], "k string, g int")
    assert sorted(map(tuple, joins.unobserved_counts(every, seen, "k", "g").collect())) == [("b", 2), ("c", 3), ("d", 3)]
