"""Draws from lists of shut places: as one by one, in slices, by blocks, and without a row for each shut place."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import negatives, open_draws, ranks


def test_images_as_permuted(spark):
    rows = [(x, n, f"k{n % 5}") for n in (1, 2, 7, 100, 1001) for x in range(min(n, 40))]
    found = spark.createDataFrame(rows, "x long, n long, k string").withColumn("v", ranks.permuted(F.col("x"), F.col("n"), F.lit(42), F.col("k"))).collect()
    assert all(r.v == open_draws.image(r.x, r.n, f"42|{r.k}") for r in found)


def _receptors(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(15), draw.randrange(12), draw.choice([draw.randrange(4), draw.randrange(60)])) for _ in range(200)]
    return spark.createDataFrame(rows, "t long, a long, b long")


def test_lists_and_not_places(spark, monkeypatch):
    """A target's shut places come as lists; those of over BLOCK places, gone through by blocks, get the same draws."""
    df = _receptors(spark)
    monkeypatch.setattr(negatives, "BLOCK", 10)
    mixed = sorted(map(tuple, negatives.other_target_negatives(df, "t", times=3).collect()))
    monkeypatch.setattr(negatives, "BLOCK", 1 << 16)
    monkeypatch.setattr(negatives, "open_places", lambda *_: pytest.fail("a row for each shut place"))
    assert sorted(map(tuple, negatives.other_target_negatives(df, "t", times=3).collect())) == mixed and mixed


def test_targets_across_batches(spark):
    """Small batches cut targets; each is still gone through whole."""
    df = _receptors(spark)
    want = sorted(map(tuple, negatives.other_target_negatives(df, "t", times=3).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(map(tuple, negatives.other_target_negatives(df, "t", times=3).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
