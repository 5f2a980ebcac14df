"""Mixing sources to target weights: exact word quotas per source, drawn as permuted blocks and dealt out by a splitting tree.

Documents fall into blocks of their source by a hash of their id, so many that a block has about BLOCK_WORDS words. A source's quota of words takes whole passes over its
blocks, then the blocks of one more pass in permuted order up to the quota; the block on the border is cut at a hash of
its documents, and the last document at a word. The drawn blocks of all sources are then divided among the output shards:
a node of the tree splits its exact block counts between two halves by a multivariate hypergeometric draw, down to single
shards. A shard's blocks are the next ones of each source's permuted sequence, so shards are disjoint, and rows are
shuffled within each shard by hash.

A row per source comes to the driver. Up to MOST_ROWS sources or drawn blocks are broadcast to the documents; more are
joined by their keys, of which none is hot: a block has about BLOCK_WORDS words whatever its source.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.llm.common import cut, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's words as a share of all words; the most passes over a source.
SHARE, MOST_PASSES = 1.5, 2
#: Blocks have BLOCK_WORDS words, or so many more that all sources have about ALL_BLOCKS, which bounds what a window sorts.
BLOCK_WORDS, ALL_BLOCKS, LEAST_BLOCKS, WORDS_PER_SHARD = 1 << 16, 1 << 20, 16, 1 << 24
#: Rows of about 100 bytes that a broadcast may have.
MOST_ROWS = 1 << 17


def small(rows: DataFrame, n: int) -> DataFrame:
    """rows, marked for a broadcast if n says that they are few."""
    return F.broadcast(rows) if n <= MOST_ROWS else rows


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST_PASSES) -> list[float]:
    """Words per source: share of the total by weight, none above most times its size; what is over goes to the rest by weight."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n]
    left = min(total, most * sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_blocks(counts: np.ndarray, shards: int, seed: int) -> list[tuple[int, int, int]]:
    """(shard, source, blocks), blocks above 0: a tree of multivariate hypergeometric draws over what each node has. Sums are exact."""
    out: list[tuple[int, int, int]] = []

    def descend(lo: int, hi: int, sources: np.ndarray, own: np.ndarray) -> None:
        sources, own = sources[own > 0], own[own > 0]
        if hi - lo == 1 or not len(own):
            out.extend((lo, int(i), int(n)) for i, n in zip(sources, own, strict=True))
            return
        mid = (lo + hi) // 2
        take = int(own.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng((seed, lo, hi)).multivariate_hypergeometric(own, take, method="marginals")
        descend(lo, mid, sources, left)
        descend(mid, hi, sources, own - left)

    descend(0, shards, np.arange(len(counts)), counts.astype(np.int64))
    return out


class Mix:
    """The decisions for one corpus: small tables per source and per drawn block, and expressions that apply them to documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, shards: int | None = None, seed: int = 17):
        spark, self.seed, self.columns = docs.sparkSession, seed, (id_col, source_col, text_col)
        self.slim = slim = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
        found = sorted(slim.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r.source is None, r.source or ""))
        sizes = [r["size"] or 0 for r in found]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share)
        quota = [min(round(t), MOST_PASSES * n) for t, n in zip(goal, sizes, strict=True)]
        passes = [divmod(q, n) if n else (0, 0) for q, n in zip(quota, sizes, strict=True)]
        self.n_sources = len(found)
        block = max(BLOCK_WORDS, sum(sizes) // ALL_BLOCKS)
        rows = [(r.source, i, n, t, *p, max(LEAST_BLOCKS, math.ceil(n / block))) for i, (r, n, t, p) in enumerate(zip(found, sizes, goal, passes, strict=True))]
        kinds = "source string, idx int, source_size long, target double, whole int, rest long, blocks long"
        sources = spark.createDataFrame(rows, kinds)

        known = self._known(slim, sources)
        by_block = known.groupBy("idx", "block", "whole", "rest").agg(F.sum("size").alias("words")).where("words > 0")
        by_pass = by_block.select("*", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("round"))
        order = W.partitionBy("idx", "round").orderBy(F.xxhash64(F.lit(seed), "idx", "round", "block"), "block")
        run = order.rowsBetween(W.unboundedPreceding, 0)
        drawn = by_pass.select("*", (F.row_number().over(order) - 1).alias("at"), F.sum("words").over(run).alias("through"))
        drawn = drawn.where("round < whole OR through - words < rest").withColumn("edge", F.expr("CASE WHEN round = whole AND through > rest THEN rest - (through - words) END"))
        ranks = W.partitionBy("idx").orderBy("round", "at")
        drawn = cut(drawn.select("idx", "block", "round", "edge", (F.row_number().over(ranks) - 1).alias("place")))

        # the last document of a source: where the hashes of the border block reach the words still wanted
        edge = known.join(small(drawn.where("edge IS NOT NULL").select("idx", "block", "edge"), len(found)), ["idx", "block"])  # one a source at most
        edge = edge.where("size > 0").groupBy("idx", "edge", self._hash().alias("h")).agg(F.sum("size").alias("words"))
        run = W.partitionBy("idx").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
        last = edge.withColumn("through", F.sum("words").over(run)).where("through >= edge AND through - words < edge")
        last = {r.idx: (r.h, r.words, r.edge - (r.through - r.words)) for r in last.collect()}
        self.sources = spark.createDataFrame([(*r, *last.get(r[1], (None, None, None))) for r in rows], kinds + ", last_h long, last_words long, last_taken long")

        counts = {r.idx: r["count"] for r in drawn.groupBy("idx").count().collect()}
        counts = np.array([counts.get(i, 0) for i in range(len(found))], np.int64)
        self.shards = shards or max(1, math.ceil(sum(quota) / WORDS_PER_SHARD))
        self.n_drawn = int(counts.sum())
        ends, pieces = [0] * len(found), []
        for shard, i, n in split_blocks(counts, self.shards, seed):  # by shard, so a source's places go up
            pieces.append((i, shard, ends[i], ends[i] + n))
            ends[i] += n
        places = spark.createDataFrame(pieces, "idx int, shard int, lo int, hi int").select("idx", "shard", F.explode(F.expr("sequence(lo, hi - 1)")).alias("place"))
        struct = F.struct("round", "shard", "edge")
        self.drawn = drawn.join(places, ["idx", "place"]).groupBy("idx", "block").agg(F.sort_array(F.collect_list(struct)).alias("rounds"))

    def _hash(self) -> Column:
        return F.xxhash64(F.lit(self.seed + 1), "doc_id")

    def _known(self, rows: DataFrame, sources: DataFrame) -> DataFrame:
        """rows with what their source has, and their block."""
        names = sources.withColumnRenamed("source", "__source")
        out = rows.join(small(names, self.n_sources), rows["source"].eqNullSafe(names["__source"]), "left").drop("__source")
        return out.withColumn("block", F.pmod(F.xxhash64(F.lit(self.seed), "doc_id"), F.col("blocks")).cast("int"))

    def taken(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, source, size, ...) and placements array<struct<round, shard, words>>: where each copy goes, with its words."""
        drawn = self.drawn.withColumnsRenamed({"idx": "__idx", "block": "__block"})
        known = self._known(rows, self.sources)
        joined = known.join(small(drawn, self.n_drawn), (known["idx"] == drawn["__idx"]) & (known["block"] == drawn["__block"]), "left")
        h = self._hash()
        part = F.when(h < F.col("last_h"), F.col("size")).when(h == F.col("last_h"), F.floor(F.col("size") * F.col("last_taken") / F.col("last_words"))).otherwise(0).cast("long")
        words = lambda r: F.when(r["edge"].isNull(), F.col("size")).otherwise(part)
        placed = F.transform("rounds", lambda r: F.struct(r["round"].alias("round"), r["shard"].alias("shard"), words(r).alias("words")))
        placed = F.filter(F.coalesce(placed, F.array().cast("array<struct<round:int,shard:int,words:bigint>>")), lambda r: r["words"] > 0)
        return joined.select(*rows.columns, "source_size", "target", placed.alias("placements"))

    def digest(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken, copies, shards) for every document. shards: of each copy `shard:words`, by round."""
        total = F.aggregate("placements", F.lit(0).cast("long"), lambda a, r: a + r["words"])
        where = F.array_join(F.transform("placements", lambda r: F.concat_ws(":", r["shard"].cast("string"), r["words"].cast("string"))), ",")
        return self.taken(self.slim).select("doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), "target", total.alias("taken"), F.size("placements").alias("copies"), where.alias("shards"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = "n_chars", slots: int = 64, **options) -> DataFrame:
    """The mixed corpus with the columns of docs: a row per copy taken, shard by shard, shuffled within each slot of a shard.

    A document cut at the quota keeps its first words, joined by single spaces, with size_col set anew. Sources that are
    null form one source; null ids share one hash; documents without words are not taken; an empty table stays empty.
    """
    mix = Mix(docs, id_col, source_col, text_col, **options)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).select(
        "__row", F.col(f"__row.`{id_col}`").alias("doc_id"), F.col(f"__row.`{source_col}`").cast("string").alias("source"), word_count(F.col(f"__row.`{text_col}`")).alias("size")
    )
    rows = mix.taken(inner).select("__row", "doc_id", "size", F.explode("placements").alias("__p"))
    order = F.xxhash64(F.lit(mix.seed + 2), "__p.shard", "__p.round", "doc_id")
    rows = rows.withColumns({"__order": order, "__slot": F.pmod(order, F.lit(slots))})
    rows = rows.repartition(F.col("__p.shard"), F.col("__slot")).sortWithinPartitions(F.col("__p.shard"), "__slot", "__order")
    whole = F.col("__p.words") == F.col("size")
    text = F.when(whole, F.col(f"__row.`{text_col}`")).otherwise(
        F.array_join(F.slice(F.filter(F.split(F.col(f"__row.`{text_col}`"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.greatest(F.col("__p.words"), F.lit(1)).cast("int")), " ")
    )
    out = {c: F.col(f"__row.`{c}`") for c in docs.columns}
    if size_col in out:
        out[size_col] = F.when(whole, out[size_col]).otherwise(F.char_length(text)).cast(docs.schema[size_col].dataType)
    out[text_col] = text
    return rows.select(*[v.alias(c) for c, v in out.items()])
