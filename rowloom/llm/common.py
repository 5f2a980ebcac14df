"""Helpers shared by the training-data operators: tables, lineage cuts, byte-level text access, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of bytes other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on, whatever the size of an Arrow batch.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir holds. Where none is set, a session of one machine gets a folder; a cluster is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder; later reads survive lost executors and don't recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet into the shared checkpoint folder; later reads take only the columns they need."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, size: Column, most: int = 1 << 24) -> DataFrame:
    """df marked for a broadcast if its rows sum to at most so many bytes; otherwise the join is left to Spark. df should be stored."""
    total = df.agg(F.sum(size.cast("double"))).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def with_floor(df: DataFrame, partitions: int) -> int:
    """A partition count for an explicit repartition: the session's shuffle partitions, at least the given number."""
    return max(partitions, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null. Each word shrinks to one mark and everything else goes, so length counts."""
    marks = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "\u0001"), "[^\u0001]", "")
    return F.char_length(marks).cast("long")


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (one more than rows); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of row ranges that hold about `most` bytes; one longer text is its own range."""
    raw, offsets = text_buffer(column)
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return np.frombuffer(raw.tobytes().lower(), np.uint8)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240611)
_BYTE_KEY = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words of a chunk. Words never reach over the end of a row."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.empty(len(raw) + 1, bool)
    inside[:-1] = ~_SPACE[raw]
    inside[-1] = False
    fresh = inside[:-1].copy()
    fresh[1:] &= ~inside[:-2]
    borders = offsets[:-1][offsets[:-1] < len(raw)]
    fresh[borders] = inside[borders]
    starts = np.flatnonzero(fresh)
    last = inside[:-1] & ~inside[1:]
    tails = offsets[1:] - 1
    tails = tails[tails >= 0]
    last[tails] = inside[tails]
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word: keyed bytes times powers by place, summed and mixed; equal words, equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    where = np.repeat(starts, lengths) + place
    parts = _BYTE_KEY[raw[where]] * _POWERS[place & 4095] + (place.astype(np.uint64) >> np.uint64(12))
    return mix64(np.add.reduceat(parts, first) ^ (lengths.astype(np.uint64) << np.uint64(48)))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each links the neighbours of a node to the smallest
    one, so long chains halve. Edges stay distributed; only two counters per round come to the driver. Every round ends in
    a checkpoint. Empty edges give an empty table; self loops are dropped.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
