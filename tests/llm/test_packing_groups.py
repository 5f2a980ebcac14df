"""Packing against plain best fit, and groups that stay bounded whatever the texts."""

import random
import time

from pyspark.sql import functions as F

from rowloom.llm import packing


def plain(sizes, sources, clusters, capacity):
    bins, out = [], []  # room, sources, clusters
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= max(size, 1) and s not in b[1] and c not in b[2]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        out.append((k, capacity - bins[k][0]))
        bins[k][0] -= size
        bins[k][1] |= {s} - {None}
        bins[k][2] |= {c} - {None}
    return out


def test_against_plain_best_fit():
    rng = random.Random(2)
    for turn in range(12):
        n = 400
        sizes = sorted((rng.randint(0, 60) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, "a", "a", "a", *map(str, range(30))]) for _ in range(n)]
        clusters = [rng.choice([None, 1, 1, *range(300)]) if turn % 2 else k for k in range(n)]
        assert packing.pack(sizes, sources, clusters, 64) == plain(sizes, sources, clusters, 64)


def test_many_short_pieces_of_one_source():
    began = time.time()
    found = packing.pack([7] * 100_000, ["a"] * 100_000, list(range(100_000)))
    assert len({b for b, _ in found}) == 100_000 and time.time() - began < 20


def test_empty_and_short_texts_spread_over_groups(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.lit(None)).otherwise("a b").alias("text"), F.lit("s").alias("source"))
    out = packing.pack_documents(docs, group_pieces=100)
    groups = out.groupBy("bin_group").count().collect()
    assert len(groups) == 30 and max(r["count"] for r in groups) < 200 and out.count() == 3000
