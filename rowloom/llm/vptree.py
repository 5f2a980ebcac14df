"""Nearest neighbours by cosine: vantage-point trees per shard, with triangle-inequality pruning that a factor relaxes.

On unit vectors the chord sqrt(2 - 2 cos) is a metric that orders as the cosine does. A top tree, fitted on a bounded
sample, routes every vector to a shard by its chord to a vantage point at each level (below the median, above it; at the
median a hash of the id decides, so many equal vectors spread over shards). Every shard builds its own tree over all its
vectors. A query first searches its home shard, which bounds its k-th chord; then only the shards, and in them only the
leaves, whose lower bound from the triangle inequality times `factor` does not exceed it. Factor 1 is an exact search;
larger ones prune more and may miss.

Queries and rows meet by shard, the rows of a shard first, then its queries batch by batch: a task holds one shard, or
one of its parts where the table has more than MOST_SHARDS * SHARD_ROWS rows. A query then visits all parts of a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.llm.common import cut, mix64, with_floor

#: The top tree has at most MOST_SHARDS leaves, which the sample can tell apart; larger tables cut every shard into parts.
K, SHARD_ROWS, MOST_SHARDS, SAMPLE, LEAF = 5, 1024, 4096, 8192, 256
#: Slack for rounding in chords, and in the cosines of one vector pair computed two ways.
EPS, TIE = 1e-7, 1e-9
FACTOR = 1.0


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """A list column as doubles; shorter vectors are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a and b in pairs, in double precision; equal pairs give equal bits wherever they stand."""
    return (unit(a) * unit(b)).sum(axis=1)


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


@dataclass
class Top:
    """The routing tree in heap order: node i has children 2i+1 and 2i+2, the leaves are the shards."""

    levels: int
    points: np.ndarray
    radii: np.ndarray

    def route(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        coin = mix64(ids.astype(np.int64).view(np.uint64))
        for level in range(self.levels):
            d, r = chord(x, self.points[node]), self.radii[node]
            right = np.where(np.abs(d - r) <= EPS, (coin >> np.uint64(level)) & np.uint64(1) == 1, d > r)
            node = 2 * node + 1 + right
        return node - ((1 << self.levels) - 1)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least chord from each query to each shard, shape (queries, shards)."""
        low = np.zeros((len(q), 1))
        for level in range(self.levels):
            nodes = np.arange((1 << level) - 1, (2 << level) - 1)
            d = np.sqrt(np.maximum(0, 2 - 2 * q @ self.points[nodes].T))
            over = d - self.radii[nodes]
            low = np.stack([np.maximum(low, over), np.maximum(low, -over)], axis=2).reshape(len(q), -1)
        return low


def fit_top(sample: np.ndarray, shards: int, seed: int = 7) -> Top:
    """A tree over unit vectors of the sample; each vantage point is the one of a few with the widest spread of chords."""
    levels = max(0, (shards - 1).bit_length())
    rng = np.random.default_rng(seed)
    points, radii = np.zeros(((1 << levels) - 1, sample.shape[1])), np.zeros((1 << levels) - 1)
    parts = {0: np.arange(len(sample))}
    for node in range(len(radii)):
        own = parts.pop(node, np.zeros(0, int))
        pool = own if len(own) else np.arange(len(sample))
        tries = rng.choice(pool, min(4, len(pool)), replace=False)
        far = [chord(sample[pool], sample[t]) for t in tries]
        best = int(np.argmax([f.std() for f in far]))
        points[node], radii[node] = sample[tries[best]], np.median(far[best])
        if len(own):
            d = far[best]
            right = np.where(np.abs(d - radii[node]) <= EPS, rng.random(len(d)) < 0.5, d > radii[node])
            parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return Top(levels, points, radii)


@dataclass
class Shard:
    """A vantage-point tree over the rows of a shard: leaves with the chord interval to every vantage point above them."""

    ids: np.ndarray
    rows: np.ndarray
    unit: np.ndarray = field(init=False)
    leaves: list[tuple[np.ndarray, list[tuple[int, float, float]]]] = field(init=False)
    vantage: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.unit, self.leaves, points = unit(self.rows), [], []
        todo = [(np.arange(len(self.ids)), [])]
        while todo:
            own, path = todo.pop()
            if len(own) <= LEAF:
                self.leaves.append((own, path))
                continue
            at = len(points)
            points.append(self.unit[own[len(own) // 2]])
            d = chord(self.unit[own], points[-1])
            order = np.argsort(d, kind="stable")
            own, d, half = own[order], d[order], len(own) // 2
            todo.append((own[:half], [*path, (at, d[0], d[half - 1])]))
            todo.append((own[half:], [*path, (at, d[half], d[-1])]))
        self.vantage = np.array(points).reshape(-1, self.unit.shape[1])

    def search(self, ids: np.ndarray, q: np.ndarray, most: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, vec_id, cosine) of up to k nearest rows of each query, within chord `most` as far as pruning tells."""
        qu = unit(q)
        to = np.sqrt(np.maximum(0, 2 - 2 * qu @ self.vantage.T))
        low = np.zeros((len(q), len(self.leaves)))
        for n, (_, path) in enumerate(self.leaves):
            for at, lo, hi in path:
                low[:, n] = np.maximum(low[:, n], np.maximum(lo - to[:, at], to[:, at] - hi))
        reach = most.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        kept = None
        nearest = low.argmin(axis=1)
        for turn in (True, False):
            for n, (own, _) in enumerate(self.leaves):
                active = np.flatnonzero(((nearest == n) == turn) & (low[:, n] * factor <= reach + EPS))
                if not len(active):
                    continue
                cos = qu[active] @ self.unit[own].T
                cos[self.ids[own][None, :] == ids[active][:, None]] = -2
                if len(own) > k:
                    kth = _kth_of_ids(cos, self.ids[own], k)
                    reach[active] = np.minimum(reach[active], np.sqrt(np.maximum(0, 2 - 2 * kth)))
                else:
                    kth = np.full(len(active), -1.5)
                floor = np.maximum(1 - (reach[active] + EPS) ** 2 / 2, kth) - TIE
                r, c = np.nonzero((cos >= floor[:, None]) & (cos > -1.5))
                found.append((active[r], own[c]))
                if sum(len(f[0]) for f in found) > 200_000:
                    kept, found = self._best(ids, q, found, kept, k), []
        p, rows, score = self._best(ids, q, found, kept, k)
        return p, self.ids[rows], score

    def _best(self, ids, q, found, kept, k):
        p = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
        rows = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
        score = cosines(q[p], self.rows[rows]) if len(p) else np.zeros(0)
        if kept is not None:
            p, rows, score = (np.concatenate(x) for x in zip(kept, (p, rows, score), strict=True))
        order = np.lexsort((self.ids[rows], -score, p))
        p, rows, score = p[order], rows[order], score[order]
        # an id that repeats in the shard counts once, by its best row
        seen: set = set()
        once = np.array([not ((a, b) in seen or seen.add((a, b))) for a, b in zip(p.tolist(), self.ids[rows].tolist(), strict=True)], bool)
        p, rows, score = p[once], rows[once], score[once]
        first = np.arange(len(p)) - np.searchsorted(p, p) < k
        return p[first], rows[first], score[first]


def _kth_of_ids(cos: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row of cos where an id that repeats counts once, by its best; -1.5 where there are fewer ids."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
    if len(first) < len(ids):
        cos = np.maximum.reduceat(cos[:, order], first, axis=1)
    if cos.shape[1] <= k:
        return np.full(len(cos), -1.5) if cos.shape[1] < k else np.maximum(cos.min(axis=1), -1.5)
    return np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & sound)


def _search(width: int, k: int, factor: float):
    """Rows of (shard, role, id, v, most) sorted by shard and role: 0 a vector, 1 a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, tree = None, [], [], None
        for batch in batches:
            shards, roles = (batch.column(i).to_numpy() for i in (0, 1))
            all_ids, x, most = batch.column(2).to_numpy(), vectors(batch.column(3), width), batch.column(4).to_numpy()
            change = np.flatnonzero(np.diff(shards) | np.diff(roles)) + 1
            for lo, hi in zip([0, *change], [*change, len(shards)], strict=True):
                if lo == hi:
                    continue
                if shards[lo] != at:
                    at, ids, rows, tree = shards[lo], [], [], None
                if roles[lo] == 0:
                    ids.append(all_ids[lo:hi])
                    rows.append(x[lo:hi])
                elif ids:
                    tree = tree or Shard(np.concatenate(ids), np.concatenate(rows))
                    for a in range(lo, hi, 1024):
                        b = min(hi, a + 1024)
                        p, found, score = tree.search(all_ids[a:b], x[a:b], most[a:b], k, factor)
                        yield pa.RecordBatch.from_arrays([pa.array(all_ids[a:b][p]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `rows` that is_query holds for, its k nearest others by cosine.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; shorter vectors count
    as padded with zeros. Ties go to the smaller id. Rows of one id count once, by their nearest vector, and never find themselves; as a
    query such an id asks with the vector that hashes least. Fewer than k
    candidates give as many rows; an empty table gives none.
    """
    found = _usable(rows, id_col, vec_col)
    queries = _usable(rows.where(is_query), id_col, vec_col).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    size = found.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    shape = "query_id long, vec_id long, score double"
    if not size.n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = min(MOST_SHARDS, 1 << max(0, math.ceil(size.n / shard_rows) - 1).bit_length())
    parts = math.ceil(size.n / (2 * shards * shard_rows))
    draw = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = found.where(draw < min(1.0, SAMPLE / size.n)).orderBy(draw, F.xxhash64("v")).select("v").limit(2 * SAMPLE).toArrow()["v"]
    sample = vectors(sample, size.width) if len(sample) else np.ones((1, size.width))
    width, top = size.width, rows.sparkSession.sparkContext.broadcast(fit_top(unit(sample), shards))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = top.value.route(unit(vectors(batch.column(1), width)), batch.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(home), *batch.columns], ["shard", *batch.schema.names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their home shard and k-th cosine so far, to all other shards that may hold something nearer."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                reach = np.sqrt(np.maximum(0, 2 - 2 * part.column(3).to_numpy()))
                low = top.value.bounds(unit(vectors(part.column(2), width)))
                low[np.arange(part.num_rows), part.column(0).to_numpy()] = np.inf
                q, shard = np.nonzero(low * factor <= (reach + EPS)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(shard), part.column(1).take(pa.array(q)), part.column(2).take(pa.array(q)), pa.array(reach[q])], ["shard", "id", "v", "most"])

    def meet(asked: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(F.lit(9), "id", "v"), F.lit(parts))
        asked = asked.withColumn("shard", F.explode(F.sequence(F.col("shard") * parts, F.col("shard") * parts + parts - 1))) if parts > 1 else asked
        held = found.mapInArrow(route, "shard long, id long, v array<double>").select((F.col("shard") * parts + part).alias("shard"), F.lit(0).alias("role"), "id", "v", F.lit(2.0).alias("most"))
        both = held.unionByName(asked.select("shard", F.lit(1).alias("role"), "id", "v", "most"))
        dealt = both.repartition(with_floor(rows, 1), "shard").sortWithinPartitions("shard", "role", "id")
        return dealt.mapInArrow(_search(width, k, factor), shape)

    home = cut(queries.mapInArrow(route, "shard long, id long, v array<double>"))
    first = cut(meet(home.withColumn("most", F.lit(2.0))))
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("kth"))
    asked = home.join(kth, "id", "left").select("shard", "id", "v", F.coalesce("kth", F.lit(-1.0)).alias("kth"))
    second = meet(asked.mapInArrow(spread, "shard long, id long, v array<double>, most double"))
    best = first.unionByName(second).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
