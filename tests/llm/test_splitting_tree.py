"""The mix's splitting tree: exact sums, the hypergeometric law of a node, disjoint blocks, and shards that get about their share."""

from collections import Counter
from math import comb

import numpy as np
from pyspark.sql import functions as F

from rowloom.llm import mixing


def test_sums_are_exact_and_shards_even():
    counts = np.array([7, 0, 1, 40, 12])
    for shards in (1, 2, 3, 7, 60, 90):
        pieces = mixing.split_blocks(counts, shards, 5)
        assert all(n > 0 and 0 <= s < shards for s, _, n in pieces)
        by_source, by_shard = Counter(), Counter()
        for s, i, n in pieces:
            by_source[i] += n
            by_shard[s] += n
        assert [by_source[i] for i in range(5)] == counts.tolist()
        sizes = [by_shard[s] for s in range(shards)]
        assert max(sizes) - min(sizes) <= 2 and pieces == mixing.split_blocks(counts, shards, 5)


def test_a_node_draws_by_the_hypergeometric_law():
    """Of 3 and 4 blocks three go left: so many of the first source with comb(3, k) comb(4, 3 - k) / comb(7, 3)."""
    got = Counter()
    for seed in range(3000):
        got[sum(n for s, i, n in mixing.split_blocks(np.array([3, 4]), 2, seed) if (s, i) == (0, 0))] += 1
    want = [3000 * comb(3, k) * comb(4, 3 - k) / comb(7, 3) for k in range(4)]
    assert sum((got[k] - w) ** 2 / w for k, w in enumerate(want)) < 16.3  # chi-square of 3, 0.1 %


def test_blocks_are_dealt_once_and_by_their_shard(spark):
    rows = [(i, "s" + str(i % 3) if i % 7 else None, "w " * (i % 50)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixing.Mix(docs, shards=5)
    placed = mix.taken(mix.slim).select("doc_id", "source", "size", F.explode("placements").alias("p")).collect()
    assert len({(r.doc_id, r.p["round"]) for r in placed}) == len(placed)  # a round takes a document once
    assert all(0 < r.p["words"] <= r["size"] for r in placed) and {r.p["shard"] for r in placed} == set(range(5))
    shard_words = Counter()
    for r in placed:
        shard_words[r.p["shard"]] += r.p["words"]
    assert max(shard_words.values()) < 1.6 * min(shard_words.values())
    digest = {r.doc_id: r for r in mix.digest().collect()}
    per = {}
    for r in placed:
        per.setdefault(r.doc_id, []).append((r.p["round"], f"{r.p['shard']}:{r.p['words']}", r.p["words"]))
    for i, r in digest.items():
        assert r.shards == ",".join(x for _, x, _ in sorted(per.get(i, []))) and r.taken == sum(w for *_, w in per.get(i, []))
