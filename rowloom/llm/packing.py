"""Best-fit packing under conflicts: pieces of documents into bins of a fixed number of tokens.

A piece is a document or, if that is longer than a bin, a part of it; pieces hold all words of all documents. A bin may
hold only one piece of a source and one of a duplicate cluster (so also one of a document); each bin carries both sets as
bitmaps. Pieces come longest first. Open bins are kept ordered by the room they have left: the search starts at the first
bin where the piece fits and goes on to its successors until one is compatible, so it finds the tightest compatible bin,
or opens a new one.
Documents are dealt to packing groups by a hash, so that each has about GROUP_WORDS words or GROUP_PIECES pieces, whichever
is less, whatever the corpus: a group's bins are the only state, and groups are independent.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import cut, with_floor, word_count

CAPACITY, GROUP_WORDS, GROUP_PIECES = 2048, 1 << 19, 4096
#: Sources and clusters with that many pieces in a group are counted room by room, so that full rooms are passed over.
HOT = 32


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the given order. Null sources and null clusters conflict with nothing."""
    keys = [[key for key in (("s", s), ("c", c)) if key[1] is not None] for s, c in zip(sources, clusters, strict=True)]
    times = Counter(key for own in keys for key in own)
    bit_of = {key: 1 << k for k, key in enumerate(key for key, n in times.items() if n > 1)}  # what comes once conflicts with nothing
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins with that room left, in order
    bins = np.zeros(capacity + 1, np.int64)
    hot = {key: np.zeros(capacity + 1, np.int64) for key, n in times.items() if n >= HOT}  # how many of them hold it
    held: list[int] = []  # bitmap of the sources and clusters in each bin
    hot_in: list[list[np.ndarray]] = []
    out = []
    for size, own_keys in zip(sizes, keys, strict=True):
        own = 0
        for key in own_keys:
            own |= bit_of.get(key, 0)
        counts = [hot[key] for key in own_keys if key in hot]
        least = max(size, 1)
        free = bins[least:] > 0
        for count in counts:
            free &= bins[least:] > count[least:]
        left, b = capacity, -1
        for room in (np.flatnonzero(free) + least).tolist():
            b = next((x for x in by_room[room] if not held[x] & own), -1)
            if b >= 0:
                left = room
                by_room[room].remove(b)
                bins[room] -= 1
                for count in hot_in[b]:
                    count[room] -= 1
                break
        if b < 0:
            b = len(held)
            held.append(0)
            hot_in.append([])
        out.append((b, capacity - left))
        left -= size
        held[b] |= own
        hot_in[b] += counts
        if left:
            insort(by_room[left], b)
            bins[left] += 1
            for count in hot_in[b]:
                count[left] += 1
    return out


def _pack_groups(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable")
            null = lambda column: [None if pd.isna(x) else x for x in column]
            found = pack(group.n_words.tolist(), null(group.source), null(group.cluster), capacity)
            group = group.assign(bin=[b for b, _ in found], start=[s for _, s in found])
            by_bin = group.groupby("bin").n_words
            return group.assign(bin_words=by_bin.transform("sum"), bin_pieces=by_bin.transform("size"))

        held: list[pd.DataFrame] = []  # the rows so far of the group that the last batch ended in
        for frame in frames:
            frame = pd.concat([*held, frame], ignore_index=True) if held else frame
            last = frame.bin_group.iloc[-1] if len(frame) else None
            for _, group in frame[frame.bin_group != last].groupby("bin_group", sort=True):
                yield one(group)
            held = [frame[frame.bin_group == last]] if len(frame) else []
        if held:
            yield one(held[0])

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_words: int = GROUP_WORDS, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece (from 0), n_words, source, cluster, bin_group and bin (together the bin), start in
    the bin, bin_words and bin_pieces.

    cluster_col names duplicate clusters (long); without it equal texts form one. Documents without words (null, empty)
    give one piece of no words that any bin takes. A document of several pieces has each in another bin. Repeated rows are
    packed as often as they come. An empty table gives no rows. Reruns agree.
    """
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    slim = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), word_count(F.col(text_col)).alias("size")))
    parts = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int")
    total = slim.agg(F.sum("size").alias("words"), F.sum(parts).alias("pieces")).first()
    groups = max(1, math.ceil((total.words or 0) / group_words), math.ceil((total.pieces or 0) / group_pieces))
    pieces = slim.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece"))
    pieces = pieces.select(
        "doc_id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("long").alias("n_words"), "source", "cluster",
        F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(groups)).alias("bin_group"),
    )
    dealt = pieces.repartition(min(groups, with_floor(docs, 1)), "bin_group").sortWithinPartitions("bin_group")
    kinds = "doc_id long, piece int, n_words long, source string, cluster long, bin_group long, bin int, start long, bin_words long, bin_pieces int"
    return dealt.mapInPandas(_pack_groups(capacity), kinds)
