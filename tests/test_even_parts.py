"""Draws are dealt over all tasks, and places don't depend on how targets are cut into blocks."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.operators import negatives, ranks


def test_rows_of_one_are_made_in_many_tasks(spark):
    df = spark.createDataFrame([("a", 0, 1 << 18)], "k string, lo long, hi long")
    per = [r["count"] for r in ranks.repeated(df, F.col("lo"), F.col("hi"), "i").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per) == 1 << 18 and len(per) > 1


@pytest.mark.parametrize("block", [2, 8, 1 << 16])
def test_places_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ranks, "BLOCK", block)
    draw, size = random.Random(block), 200
    blocked = {"few": {0, 199}, "many": set(draw.sample(range(size), 150)), "early": set(range(40)) - {7}, None: set(draw.sample(range(size), 30)), "none": set()}
    segments, draws = [], []
    for t, places in blocked.items():
        cuts = [p for p in sorted(places) if p - 1 not in places or p % 5 == 0]  # some touch
        for lo in cuts:
            end = lo + 1
            while end in places and end not in cuts:
                end += 1
            segments.append((t, lo, end - lo))
        draws += [(t, r, i) for r in range(size - len(places)) for i in range(2)]
    got = ranks.open_places(spark.createDataFrame(segments, "t string, lo long, len long"), spark.createDataFrame(draws, "t string, rank long, i int"), ["t"])
    want = {t: [p for p in range(size) if p not in places] for t, places in blocked.items()}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((t, r, i, want[t][r])) for t, r, i in draws)


def test_running_in_blocks(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, "a", "b"]), i, draw.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, at long, v int").withColumn("block", F.floor(F.col("at") / 7))
    sums = {}
    want = []
    for g, at, v in rows:
        want.append((g, at, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + v
    assert sorted(map(repr, map(tuple, ranks.running_in_blocks(df, ["g"], "block", ["at"], {"s": "v"}).select("g", "at", "s").collect()))) == sorted(map(repr, want))


def test_groups_of_odd_receptors(spark):
    """The compiled way for two plain chains gives what the general one gives."""
    texts = ["CASF/CAW", "", None, "c f / c w ", "CFW/FWC", "C", "/", "CA//CFW", " CASF/ CAT\t", "CC/FF", "CAF/CAW/CAF", "\nCA F/CA"]
    df = spark.createDataFrame([(t,) for t in texts], "ab string")
    chain = lambda c: c.strip(" \t\n\x0b\f\r").lstrip("C").rstrip("FW")
    for r in df.select("ab", S.endpoint_group(F.col("ab")).alias("g")).collect():
        assert r.g == "/".join(chain(c) for c in (r.ab or "").strip(" \t\n\x0b\f\r").upper().split("/"))


def test_quota_over_units_of_many_places(spark):
    """Rights with many rows each, met again and again: as many distinct ones as wanted, none known."""
    rows = [(f"p{i % 3}", i % 40) for i in range(400) if i % 40 != 7 * (i % 3)] + [("q", 7)] * 60
    df = spark.createDataFrame(rows, "pep string, tcr int")
    got = negatives.recombined_to_quota(df, "pep", "tcr", 0.5).collect()
    mine = sorted(r.draw for r in got if r.pep == "q")
    assert mine == list(range(30)) and len({r.tcr for r in got if r.pep == "q"}) == 30 and 7 not in {r.tcr for r in got if r.pep == "q"}


def test_ranked_negatives_go_round_the_pool(spark):
    """By brute force: the first open donors from the drawn place on and round the end; a null peptide is one like any other."""
    rows = [(p, f"CA{i}F/CX{i % 4}") for p, step in (("p", 2), ("q", 3), (None, 5)) for i in range(0, 40, step)]
    df = spark.createDataFrame(rows, "pep string, ab string")
    want = df.select("pep", F.lit(12).alias("wanted")).distinct()
    place = {r.ab: r.idx for r in negatives.numbered_pool(df).collect()}
    size, donors = len(place), {i: ab for ab, i in place.items()}
    starts = {r.pep: r.at for r in want.select("pep", negatives.draw_index(size, F.lit("42"), F.col("pep")).alias("at")).collect()}
    got = {(r.pep, r.k): r.ab for r in negatives.ranked_negatives(want, df, df, "wanted").collect()}
    for p in ("p", "q", None):
        ring = [donors[(starts[p] + i) % size] for i in range(size)]
        free = [ab for ab in ring if (p, ab) not in set(rows)]
        assert [got.get((p, k)) for k in range(1, 13)] == (free + [None] * 12)[:12]
