"""Draws from places that are open to a target, where what is shut comes as lists of places: one row for each list, not for each place.

Rows of a target are next to each other in their task, which goes through whole targets of one Arrow batch at once in numpy.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def image(x: int, n: int, name: str) -> int:
    """ranks.permuted() of plain numbers; name is its key, joined."""
    wide = math.ceil(math.sqrt(n))
    high = math.ceil(n / wide)
    begin = hashlib.md5(f"{name}|".encode())

    def hashed(turn: int, v: int) -> int:
        h = begin.copy()
        h.update(b"%d|%d" % (turn, v))
        return int.from_bytes(h.digest()[:7], "big") >> 4

    while True:
        at, rest = divmod(x, high)
        for turn in (0, 2):
            at = (at + hashed(turn, rest)) % wide
            rest = (rest + hashed(turn + 1, at)) % high
        x = at * high + rest
        if x < n:
            return x


def _whole_targets(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[pa.Table]:
    """Tables of whole targets; the last target of a batch waits for its rest."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(target)
        same = pc.fill_null(pc.equal(key, key[-1]), False).to_numpy(zero_copy_only=False)
        first = int(np.argmax(same))
        if held and key[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _drawn(table: pa.Table, target: str, size: int, times: int) -> pa.Table:
    column = {c: table[c].combine_chunks() for c in (target, "lo", "len", "places", "name")}
    key, band = column[target], size + 1  # target k has the numbers from k * band on
    of = np.concatenate(([0], np.cumsum(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)))).astype(np.int64) * band
    is_run, is_list, is_own = (pc.is_valid(column[c]).to_numpy(zero_copy_only=False) for c in ("lo", "places", "name"))
    run, length = of[is_run] + column["lo"].drop_null().to_numpy(), column["len"].drop_null().to_numpy()
    order = np.argsort(run)
    run, length = run[order], length[order]
    lists = column["places"].drop_null()
    single = np.repeat(of[is_list], pc.list_value_length(lists).to_numpy()) + lists.flatten().to_numpy().astype(np.int64)
    if len(run):
        before = np.searchsorted(run, single, "right") - 1
        single = single[(before < 0) | (single >= run[before] + length[before])]  # what a run holds is shut once
    starts = np.concatenate((run, single))
    order = np.argsort(starts)
    starts = starts[order]
    sums = np.concatenate(([0], np.cumsum(np.concatenate((length, np.ones(len(single), np.int64)))[order])))
    own = starts // band * band
    starts -= sums[:-1] - sums[np.searchsorted(starts, own)]  # the first rank that a segment shifts
    mine = of[is_own]
    first, end = np.searchsorted(starts, mine), np.searchsorted(starts, mine + band)
    opened = size - (sums[end] - sums[first])
    count = np.minimum(times, opened)
    row = np.repeat(np.arange(len(mine)), count)
    draw = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    names = column["name"].drop_null().to_pylist()
    rank = np.fromiter((image(x, n, names[i]) for x, n, i in zip(draw.tolist(), opened[row].tolist(), row.tolist(), strict=True)), np.int64, len(row))
    place = rank + sums[np.searchsorted(starts, mine[row] + rank, "right")] - sums[first[row]]
    out = table.select([target, "a", "b"]).filter(pa.array(is_own)).take(pa.array(row))
    return out.append_column("draw", pa.array(draw)).append_column("place", pa.array(place))


def drawn_places(runs: DataFrame, lists: DataFrame, own: DataFrame, target: str, size: int, times: int, seed: int) -> DataFrame:
    """(target, a, b, draw, place): for each row of own (target, a, b) the places in [0, size) of `times` draws from those that neither
    runs (target, lo, len) nor lists (target, places) shut its target out of, by permuted() with the row as its key. Runs
    don't overlap, nor do lists. A target's rows are held in a task, so it should have a bounded number of places.
    """
    columns = {"lo": "bigint", "len": "bigint", "places": lists.schema["places"].dataType, "a": "string", "b": "string"}
    every = None
    for part in (runs, lists, own):
        part = part.select(target, *[(F.col(c) if c in part.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])
        every = part if every is None else every.unionByName(part)
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.when(F.col("a").isNotNull(), F.concat_ws("|", F.lit(seed).cast("string"), F.col(target).cast("string"), "a", "b"))
    dealt = every.repartition(parts, target).sortWithinPartitions(target).withColumn("name", name)
    out = own.select(target, "a", "b", F.lit(0).cast("bigint").alias("draw"), F.lit(0).cast("bigint").alias("place")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_targets(batches, target):
            yield from _drawn(table, target, size, times).to_batches(1 << 16)

    return dealt.mapInArrow(run, out)
