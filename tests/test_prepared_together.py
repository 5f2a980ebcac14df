"""Workspaces whose corpora go through the plan together."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.operators import joins, negatives, splits
from rowloom.plans.prepare import Config, prepare
from rowloom.schema import Caps

_COLUMNS = "corpus string, pep string, hla string, hla_allele string, ab string, label int"


def _rows(spark):
    rng, letters = random.Random(3), "ACDEFGHIKLMNPQRSTVWY"
    peps = ["".join(rng.choice(letters) for _ in range(12)) for _ in range(12)] + ["short1", None]
    return spark.createDataFrame([(c, rng.choice(peps), "S1", rng.choice(("S1", "S2")), f"CA{rng.choice(letters)}{rng.choice(letters)}F/C{rng.choice('ST')}F", 1) for c in "xyz" for _ in range(150)], _COLUMNS)


@pytest.mark.parametrize("grouping", ["pair_stratified", "peptide", "cluster"])
def test_one_table_is_read_once(spark, grouping):
    """One table with all corpora gives what they give by name, and each row is read once."""
    rows = _rows(spark).cache()
    test = rows.where("corpus = 'x' AND pep <> 'short1'").dropDuplicates(["pep"]).orderBy("pep").limit(2).drop("corpus")
    config, seen = Config("x", grouping, caps=Caps(1, 40, 2, 40)), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(x):
        seen.add(1)
        return x

    made = prepare(rows.withColumn("pep", same("pep")), test, config)
    assert seen.value == rows.count()
    named = prepare({c: rows.where(F.col("corpus") == c).drop("corpus") for c in "xyz"}, test, config)
    assert sorted(made) == sorted(named) == ["x", "y", "z"]
    for c, w in made.items():
        assert w["report"] == named[c]["report"] and w["report"]["train"] == w["train"].count() > 0 and w["report"]["excluded"] > 0
        for part in ("train", "valid", "test", "pool", "blocked"):
            assert sorted(map(tuple, w[part].collect()), key=repr) == sorted(map(tuple, named[c][part].collect()), key=repr)
    w = made["x"]
    known = w["test"].select("pep", "ab").unionByName(w["valid"].where("label = 1").select("pep", "ab"))
    for x in made.values():
        known = known.unionByName(x["train"].select("pep", "ab"))
    assert sorted(map(tuple, w["blocked"].collect())) == sorted(map(tuple, joins.blocked_pairs(known, known).collect()))
    assert w["valid"].where("label = 0").count() > 0


def test_draws_by_place(spark):
    """What is shut out as places gives the draws that known pairs give."""
    known = _rows(spark).where("pep IS NOT NULL").select("pep", "ab").distinct()
    wanted = known.where("ab < 'CAL'").select("pep", F.col("ab").alias("of"))
    donors = negatives.numbered_donors(known)
    shut = known.select("pep", S.endpoint_group(F.col("ab")).alias("__grp")).distinct().join(donors, "__grp").select("pep", "place")
    got = negatives.negatives_by_place(wanted, donors, shut, 5)
    want = negatives.drawn_negatives(wanted, known, known, 5)
    assert sorted(map(tuple, got.select("pep", "of", "ab").collect())) == sorted(map(tuple, want.select("pep", "of", "ab").collect()))


def test_few_groups_of_many_rows_are_broadcast(spark):
    """The chosen groups have a known size, so that rows aren't dealt by group, where a common one would be one task's."""
    rows = spark.range(3_000_000).select((F.col("id") % 500).alias("cluster"), F.col("id").alias("x"))
    chosen = splits.group_validation(rows, "cluster", 0.1)
    assert "BroadcastHashJoin" in joins.in_keys(rows, chosen, ["cluster"])._jdf.queryExecution().sparkPlan().toString() and chosen.count() == 50
