"""LM scoring: a hierarchical Pitman-Yor model of token pairs, its seating sampled by Gibbs, its predictions averaged.

Every context (the token before) has a restaurant, whose parent is the one of all contexts, whose parent is uniform over
the types and one more for the unseen. The state of a dish in a restaurant is its number of tables. A sweep unseats and
seats again every customer of every cell: leaving closes a table with probability S(c-1, t-1) / S(c, t) (ratios of
generalized Stirling numbers), a new table costs the parent's probability; new tables are the parent's customers. Counts
above BLOCKS move in that many blocks, whose closed and opened tables are binomial draws. A pair seen once has one table,
so only the others are sampled. Draws come from hashes of the cell, so reruns agree.

The predictive probability of a pair is averaged over the kept sweeps: (c - d t + (s + d T) P) / (s + C), with T tables
and C customers in the context's restaurant and P the parent's probability of the token, all of the same sweep.

How it is spread out. Texts are tokenized once, into chunks of about CHUNK bytes that are stored as packed arrays. Tokens
and pairs are dealt to buckets of about BUCKET places each: a chunk sends each bucket its distinct keys in order, as one
packed message, and the bucket answers with an array in the same order, so nothing is joined by key. Token buckets number
the types (32 bits) and hold a type's counts and root tables; a pair is the two numbers in 64 bits, mixed reversibly, and
pair buckets hold the cells of pairs seen twice or more. In a sweep pair buckets tell token buckets by how much customers
exceed tables (which is nothing for pairs seen once), and get the sums back. A pair or token, however frequent, is one key
of a chunk's message, so there are no hot keys; memory of a task is a chunk's or a bucket's.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import ensure_checkpoint_dir, lower_ascii, mix64, text_chunks, with_floor, word_hashes, words_of

CHUNK, BUCKET = 3 << 20, 1 << 21
#: Buckets that a task of a sweep goes through one after the other: their tables are small beside what they were made of.
AT_ONCE = 4
BURN, KEEP, BLOCKS = 2, 3, 16
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
END = np.uint64(0x5DEECE66D1234567)
#: Numbers of types are 32 bits wide, so that a pair is 64.
MOST_TYPES = 1 << 32
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts of a chunk, each text's end token after its words, and the offsets of the texts."""
    raw = lower_ascii(raw)
    n = len(offsets) - 1
    if n == 1 and len(raw) > 2 * CHUNK:  # one long text: by parts that end at a space
        parts, lo = [], 0
        while lo < len(raw):
            hi = min(len(raw), lo + CHUNK)
            while hi < len(raw) and raw[hi] != 0x20 and not 0x09 <= raw[hi] <= 0x0D:
                hi += 1
            starts, ends, _ = words_of(raw[lo:hi], np.array([0, hi - lo]))
            parts.append(word_hashes(raw[lo:hi], starts, ends))
            lo = hi
        out = np.concatenate([*parts, [END]])
        return out, np.array([0, len(out)])
    starts, ends, rows = words_of(raw, offsets)
    out = np.full(len(starts) + n, END, np.uint64)
    out[np.arange(len(starts)) + rows] = word_hashes(raw, starts, ends)
    return out, np.searchsorted(rows, np.arange(n + 1)) + np.arange(n + 1)


@dataclass
class Stirling:
    """Ratios S(c-1, t-1) / S(c, t) for one discount: exact up to a count, then their limit d (t-1) / (c-1)."""

    discount: float
    most: int = 160

    def __post_init__(self) -> None:
        n, d = self.most, self.discount
        log = np.full((n + 1, n + 2), -np.inf)
        log[0, 0] = 0.0
        for c in range(n):
            stay = c - d * np.arange(n + 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                stayed = log[c] + np.where(stay > 0, np.log(np.maximum(stay, 1e-300)), -np.inf)
            log[c + 1] = np.logaddexp(stayed, np.concatenate(([-np.inf], log[c, :-1])))
        self.ratio = np.zeros((n + 1, n + 2))
        with np.errstate(invalid="ignore"):
            self.ratio[1:, 1:] = np.exp(log[:-1, :-1] - log[1:, 1:])
        self.ratio = np.nan_to_num(self.ratio)

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        small = c <= self.most
        exact = self.ratio[np.minimum(c, self.most), np.minimum(t, self.most)]
        return np.where(small, exact, np.minimum(1.0, self.discount * (t - 1) / np.maximum(c - 1, 1)))


def _uniform(keys: np.ndarray, turn: int) -> np.ndarray:
    seed = (turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return (mix64(keys ^ np.uint64(seed)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def start_tables(c: np.ndarray, a: np.ndarray, d: float) -> np.ndarray:
    """About as many tables as customers seated one by one would open, where a is the weight of a new one."""
    t, i = np.minimum(c, 1).astype(float), np.ones(len(c))
    while (i < c).any():
        step = np.minimum(np.maximum(1, np.floor(i * 0.3)), c - i)
        t = np.minimum(t + np.maximum(step, 0) * a / np.maximum(i - d * t + a, 1e-9), c)
        i = np.where(i < c, i + step, i)
    return np.clip(np.round(t), np.minimum(c, 1), c).astype(np.int64)


def binomial(m: np.ndarray, p: np.ndarray, keys: np.ndarray, turn: int) -> np.ndarray:
    """Successes among m draws of probability p: by the inverse distribution, or its normal limit where the variance is large."""
    p = np.clip(p, 0.0, 1.0)
    u = _uniform(keys, turn)
    out = ((u < p) & (m == 1)).astype(np.int64)
    many = np.flatnonzero(m > 1)
    if len(many):
        n, q, v = m[many].astype(float), np.minimum(p, 1 - p)[many], u[many]
        far = n * q * (1 - q) > 20
        term = np.where(far, 0.0, np.exp(n * np.log1p(-q)))
        k, total = np.zeros(len(many)), term.copy()
        for i in range(1, 100):
            more = ~far & (v >= total) & (k < n)
            if not more.any():
                break
            term = term * (n - i + 1) / i * q / (1 - q)
            total, k = total + term, k + more
        z = np.sqrt(-2 * np.log(np.maximum(v, 1e-300))) * np.cos(2 * np.pi * _uniform(mix64(keys[many]), turn))
        k = np.where(far, np.clip(np.round(n * q + z * np.sqrt(n * q * (1 - q))), 0, n), k)
        out[many] = np.where(p[many] > 0.5, n - k, k).astype(np.int64)
    return out


def gibbs(c: np.ndarray, t: np.ndarray, a: np.ndarray, keys: np.ndarray, ratio: Stirling, turn: int) -> np.ndarray:
    """Tables after every customer of each dish was unseated and seated again; a: weight of a new table, fixed for the sweep."""
    for k in range(min(BLOCKS, int(c.max(initial=0)))):
        m = np.where(c <= BLOCKS, k < c, c * (k + 1) // BLOCKS - c * k // BLOCKS)
        u = 2 * (turn * BLOCKS + k)
        t = t - np.minimum(binomial(m, np.where(t > 1, ratio(c, t), 0.0), keys, u), np.maximum(t - 1, 0))
        opened = binomial(m, a / np.maximum(c - (m + 1) / 2 - ratio.discount * t + a, 1e-12), keys, u + 1)
        t = np.where(c > 1, np.minimum(t + opened, c), t)
    return t


def discount_of(once: float, twice: float) -> float:
    """The usual estimate from numbers of types seen once and twice, kept inside (0, 1)."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once else 0.5


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value. Integers (none negative) that never fall go as differences; all go byte by byte."""
    heads, bodies = [], []
    for x in arrays:
        y, rises = np.ascontiguousarray(x), False
        if x.dtype.kind in "iu":
            rises = len(x) > 1 and bool((x[1:] >= x[:-1]).all())
            y = x.astype(np.uint64)
            y = np.diff(y, prepend=np.uint64(0)) if rises else y
        width = max(1, (int(y.max(initial=0)).bit_length() + 7) // 8) if x.dtype.kind in "iu" else y.itemsize
        heads.append((x.dtype.str, len(x), rises, width))
        bodies.append(np.ascontiguousarray(y.view(np.uint8).reshape(len(y), y.itemsize)[:, :width].T).tobytes())
    head = pickle.dumps(heads)
    raw = b"".join([head, *bodies])
    return len(raw).to_bytes(8, "little") + len(head).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = pa.decompress(value[12:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    at, out = int.from_bytes(value[8:12], "little"), []
    for kind, n, rises, width in pickle.loads(raw[:at]):
        kind = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        at += n * width
        full = np.zeros((n, 8 if kind.kind in "iu" else kind.itemsize), np.uint8)
        full[:, :width] = planes.T
        x = full.view(np.uint64 if kind.kind in "iu" else kind).reshape(n)
        out.append((np.cumsum(x, dtype=np.uint64) if rises else x).astype(kind))
    return out


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""
    word = 1 << 64
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, word))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, word))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def bucket_edges(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of sorted 64-bit keys, by their high bits; empty buckets are left out."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    for lo, hi in zip(first, np.append(first[1:], len(of)), strict=True):
        yield int(of[lo]), int(lo), int(hi)


# --- messages: (receiver, kind, sender, body) ---------------------------------------------------------------------------
STATE, WORDS, IDS, PAIRS, CLASSES, TELL, SUMS, TOKEN_VALUES, PAIR_VALUES = range(9)
_ROW = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("frm", pa.int64()), ("body", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.int64())])
_ROWS = "to bigint, kind int, frm bigint, body binary, a bigint, b bigint, c bigint, d bigint"
Row = tuple  # to, kind, frm, body and up to four totals


def _sent(rows: list[Row], batch: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about that many bytes."""
    lo = size = 0
    for hi, r in enumerate(rows, 1):
        size += len(r[3])
        if size >= batch or hi == len(rows):
            part = [(*r, *(0,) * (8 - len(r))) for r in rows[lo:hi]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], _ROW.field(i).type) for i in range(8)], schema=_ROW)
            lo, size = hi, 0


def _by_receiver(answer):
    """answer(receiver, {kind: [(sender, body)] in order of sender}) -> rows, over rows sorted by receiver, kind and sender."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for to, kind, frm, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if to != at and held:
                    yield from _sent(answer(at, held))
                    held = {}
                at = to
                held.setdefault(kind, []).append((frm, body))
        if held:
            yield from _sent(answer(at, held))

    return run


def _meet(rows: list[DataFrame], receivers: int, answer, at_once: int = 1) -> DataFrame:
    """The rows of all tables by their receiver, a number below `receivers`; a task has at_once of them, one after the other."""
    every = rows[0].select("to", "kind", "frm", "body")
    for more in rows[1:]:
        every = every.unionByName(more.select("to", "kind", "frm", "body"))
    dealt = every.repartitionById(-(-receivers // at_once), F.floor(F.col("to") / at_once).cast("int"))
    return dealt.sortWithinPartitions("to", "kind", "frm").mapInArrow(_by_receiver(answer), _ROWS)


class Store:
    """Tables as Parquet in the shared checkpoint folder; a name stored again replaces the one before."""

    def __init__(self, spark):
        ensure_checkpoint_dir(spark)
        self.spark, self.at = spark, {}
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pitmanyor-{uuid.uuid4().hex}"

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")  # the plan runs once, so its shuffle files go with the end of the write
        try:
            df.write.option("parquet.block.size", 16 << 20).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.drop(name)
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if old := self.at.pop(name, None):
            old = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)


# --- what chunks and buckets do -----------------------------------------------------------------------------------------
def _tokenized(most: int):
    """Kept columns, train and text to kept columns, chunk, at, n_tokens; the first row of a chunk holds its arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            train = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, raw, offsets in text_chunks(batch.column(batch.num_columns - 1), most):
                hashes, bounds = tokens_of(raw, offsets)
                sizes, own = np.diff(bounds), train[lo:hi]
                keys, place = np.unique(hashes, return_inverse=True)
                counts = np.bincount(place, np.repeat(own, sizes), len(keys)).astype(np.int64)
                body, words = [None] * (hi - lo), [None] * (hi - lo)
                body[0], words[0] = pack(place.astype(np.uint32), sizes, own.view(np.uint8)), pack(keys, counts)
                kept = [c.slice(lo, hi - lo) for c in batch.columns[:-2]]
                more = [pa.array(np.full(hi - lo, chunk)), pa.array(np.arange(hi - lo)), pa.array(sizes), pa.array(body, pa.binary()), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays([*kept, *more], [*batch.schema.names[:-2], "chunk", "at", "n_tokens", "body", "words"])
                chunk += 1

    return run


def _ask_tokens(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = unpack(words)
                yield from _sent([(b, WORDS, chunk, pack(keys[lo:hi], counts[lo:hi])) for b, lo, hi in bucket_edges(keys, buckets)])

    return run


def _merged(asked: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Distinct keys, their counts, and of each sender the places of its keys."""
    senders, parts = [s for s, _ in asked], [unpack(x) for _, x in asked]
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
    ends = np.cumsum([0, *(len(p[0]) for p in parts)])
    return keys, counts, [(s, place[lo:hi]) for s, lo, hi in zip(senders, ends, ends[1:], strict=False)]


def _number_tokens(bucket: int, got: dict) -> list[Row]:
    keys, c, places = _merged(got[WORDS])
    state = (bucket, STATE, len(keys), pack(c, c), int((c > 0).sum()), int(c.sum()), int((c == 1).sum()), int((c == 2).sum()))
    return [state, *((s, IDS, bucket, pack(x.astype(np.uint32))) for s, x in places)]


def _places(got: dict, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: the token at each place (its number in the chunk), the one before it, the pair, the sizes of the texts,
    which of them train, and the offsets of the texts."""
    place, sizes, train = unpack(got[STATE][0][1])
    ids = np.concatenate([unpack(x)[0].astype(np.uint64) + np.uint64(starts[b]) for b, x in got[IDS]])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    before = np.roll(place, 1)
    before[bounds[:-1]] = place[-1]  # the end token
    return place, before, mix64((ids[before] << np.uint64(32)) | ids[place]), sizes, train, bounds


def _ask_pairs(starts: np.ndarray, buckets: int):
    def answer(chunk: int, got: dict) -> list[Row]:
        _, _, pairs, sizes, train, _ = _places(got, starts)
        keys, place = np.unique(pairs, return_inverse=True)
        counts = np.bincount(place, np.repeat(train, sizes), len(keys)).astype(np.int64)
        return [(b, PAIRS, chunk, pack(keys[lo:hi], counts[lo:hi])) for b, lo, hi in bucket_edges(keys, buckets)]

    return answer


def _make_cells(bucket: int, got: dict) -> list[Row]:
    keys, c, places = _merged(got[PAIRS])
    cells = np.flatnonzero(c > 1)
    number = np.cumsum(c > 1) - 1
    both = unmix64(keys[cells])
    u, w = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
    rows = [(bucket, STATE, bucket, pack(u, w, c[cells], np.ones(len(cells), np.int64), np.zeros(len(cells), np.int64)), int((c == 1).sum()), int((c == 2).sum()))]
    for s, x in places:
        kind = np.minimum(c[x], 2).astype(np.uint8)
        rows.append((s, CLASSES, bucket, pack(kind, number[x[kind == 2]])))
    return rows


def _told(bucket: int, u: np.ndarray, w: np.ndarray, more: np.ndarray, starts: np.ndarray) -> list[Row]:
    """To the token buckets: by how much customers exceed tables, of each token as a context and as a dish."""
    ids, place = np.unique(np.concatenate((u, w)), return_inverse=True)
    sums = [np.bincount(p, more, len(ids)).astype(np.int64) for p in (place[: len(u)], place[len(u) :])]
    edges = np.searchsorted(ids, starts)
    return [(int(b), TELL, bucket, pack(*(x[edges[b] : edges[b + 1]] for x in (ids - np.uint32(starts[b]), *sums)))) for b in np.flatnonzero(np.diff(edges))]


def _first_told(starts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, w, c, t, _ = unpack(body)
                yield from _sent(_told(bucket, u, w, c - t, starts))

    return run


def _seat_roots(turn: int, weight: float, ratio: Stirling, starts: np.ndarray):
    """Root tables of a token bucket's types, given the tables that pair buckets have told; kept turns are added to the state."""

    def answer(bucket: int, got: dict) -> list[Row]:
        c, s, *kept = unpack(got[STATE][0][1])
        tables, own, asked = c.copy(), c.copy(), []
        for sender, body in got.get(TELL, ()):
            ids, du, dw = unpack(body)
            tables[ids] -= du
            own[ids] -= dw
            asked.append((sender, ids))
        weights, keys = np.full(len(c), weight), mix64(np.arange(starts[bucket], starts[bucket] + len(c), dtype=np.uint64) + np.uint64(77))
        s = start_tables(own, weights, ratio.discount) if turn < 0 else np.clip(s, np.minimum(own, 1), own)
        s = gibbs(own, s, weights, keys, ratio, turn + 1)
        kept += [tables, own, s] if turn >= BURN else []
        return [(bucket, STATE, len(c), pack(c, s, *kept), int(s.sum()), int(own.sum())), *((x, SUMS, bucket, pack(tables[ids], own[ids], s[ids])) for x, ids in asked)]

    return answer


@dataclass(frozen=True)
class Root:
    """The restaurant of all contexts in one sweep."""

    discount: float
    fresh: float  # weight of a new table of one type
    customers: float

    def chance(self, own: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (own - self.discount * s + self.fresh) / (ROOT_STRENGTH + self.customers)


def _seat_cells(turn: int, root: Root, ratio: Stirling, starts: np.ndarray):
    d = ratio.discount

    def answer(bucket: int, got: dict) -> list[Row]:
        u, w, c, t, kept = unpack(got[STATE][0][1])
        if not len(c):
            return [(bucket, STATE, bucket, got[STATE][0][1])]
        ids, place = np.unique(np.concatenate((u, w)), return_inverse=True)
        tables, own, s = (np.concatenate(x) for x in zip(*(unpack(body) for _, body in got[SUMS]), strict=True))
        kept = kept + t if turn >= BURN else kept  # the seating that the token sums of this turn belong to
        weight = (STRENGTH + d * tables[place[: len(u)]]) * root.chance(own, s)[place[len(u) :]]
        keys = mix64((u.astype(np.uint64) << np.uint64(32)) | w)
        t = start_tables(c, weight, d) if turn < 0 else gibbs(c, t, weight, keys, ratio, turn)
        return [(bucket, STATE, bucket, pack(u, w, c, t, kept)), *_told(bucket, u, w, c - t, starts)]

    return answer


def _token_values(bucket: int, got: dict) -> list[Row]:
    """Whole numbers that are mostly 0 for rare types: a type's count, and of each kept turn what it lacks in tables, and root tables."""
    c, _, *kept = unpack(got[STATE][0][1])
    values = [c, *(kept[i] if i % 3 == 2 else c - kept[i] for i in range(len(kept)))]
    return [(chunk, TOKEN_VALUES, bucket, pack(*(x[ids] for x in values))) for chunk, body in got[IDS] for ids in unpack(body)]


def _pair_values(bucket: int, got: dict) -> list[Row]:
    """Count of each pair that a chunk has, and its tables summed over the kept turns."""
    _, _, c, _, kept = unpack(got[STATE][0][1])
    out = []
    for chunk, body in got[CLASSES]:
        kind, place = unpack(body)
        count, tables = kind.astype(np.int64), kind.astype(np.int64) * KEEP
        count[kind == 2], tables[kind == 2] = c[place], kept[place]
        out.append((chunk, PAIR_VALUES, bucket, pack(count, tables)))
    return out


def _score_chunks(starts: np.ndarray, discount: float, roots: list[Root], n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(chunk: int, got: dict) -> pa.RecordBatch:
            place, before, pairs, _, _, bounds = _places(got, starts)
            c, *kept = (np.concatenate(x) for x in zip(*(unpack(body) for _, body in got[TOKEN_VALUES]), strict=True))
            count, seated = (np.concatenate(x) for x in zip(*(unpack(body) for _, body in got[PAIR_VALUES]), strict=True))
            p = (count - discount * seated / KEEP)[np.unique(pairs, return_inverse=True)[1]]
            for k, root in enumerate(roots):
                lacking, own, s = kept[3 * k : 3 * k + 3]
                p += (STRENGTH + discount * (c - lacking)[before]) * root.chance(c - own, s)[place] / KEEP
            logs = np.log10(p / (STRENGTH + c[before]))
            base = (np.log10(c + 1.0) - math.log10(n + 1.0 * (v + 1)))[place]
            sums = [np.add.reduceat(x, bounds[:-1]) for x in ((c > 0).astype(np.int64)[place], base, logs)]
            texts = len(bounds) - 1
            return pa.RecordBatch.from_arrays([pa.array(np.full(texts, chunk)), pa.array(np.arange(texts)), *map(pa.array, sums)], ["chunk", "at", "n_known", "base_score", "score"])

        at, held = None, {}
        for batch in batches:
            for to, kind, frm, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if to != at and held:
                    yield one(at, held)
                    held = {}
                at = to
                held.setdefault(kind, []).append((frm, body))
        if held:
            yield one(at, held)

    return run


def scores(docs: DataFrame, train: Column, keep: list[str], text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The columns of keep and n_tokens, n_known, train_tokens, base_score, score of every row of docs, over whole texts,
    under a model of the rows that `train` holds for (null: it doesn't).

    Null and empty texts have the end token only. Null ids and repeated rows pass through; repeated rows that train count
    as often as they come. No training row: all tokens are unseen. An empty table gives an empty one. Base: log10 of
    (c + 1) / (n + v + 1). More than 2^32 types are refused. Other columns of docs, whatever their names, play no part.
    """
    spark = docs.sparkSession
    store = Store(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-2]]
    texts = store("texts", slim.mapInArrow(_tokenized(chunk), ", ".join([*kinds, "chunk bigint, at bigint, n_tokens bigint, body binary, words binary"])))
    places = texts.agg(F.sum("n_tokens")).first()[0] or 0
    buckets, tasks = max(1, math.ceil(places / BUCKET)), with_floor(docs, 1)  # buckets follow the corpus alone: tiny ones would cost more in tasks than they hold
    chunks = texts.where("body IS NOT NULL")
    kind = lambda df, k: df.where(F.col("kind") == k)
    turned = lambda df, k: kind(df, k).select(F.col("frm").alias("to"), "kind", F.col("to").alias("frm"), "body")  # noqa: E731  to those who sent it

    asked = chunks.select("chunk", "words").mapInArrow(_ask_tokens(buckets), _ROWS)
    tokens = store("tokens", _meet([asked], buckets, _number_tokens))
    texts = store("texts", texts.drop("words"))
    bodies = texts.where("body IS NOT NULL").select(F.col("chunk").alias("to"), F.lit(STATE).alias("kind"), F.lit(0).cast("long").alias("frm"), "body")
    sizes, totals = np.zeros(buckets, np.int64), np.zeros(4, np.int64)
    for r in kind(tokens, STATE).select("to", "frm", "a", "b", "c", "d").collect():  # a row for each bucket
        sizes[r.to] = r.frm
        totals += (r.a, r.b, r.c, r.d)
    v, n, once, twice = map(int, totals)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    if starts[-1] > MOST_TYPES:
        raise ValueError(f"{starts[-1]} types don't fit 32 bits")
    ids = kind(tokens, IDS)

    whole = bodies.unionByName(ids.select("to", "kind", "frm", "body")).repartition(tasks, "to").sortWithinPartitions("to", "kind", "frm")
    told = whole.mapInArrow(_by_receiver(_ask_pairs(starts, buckets)), _ROWS)
    pairs = store("pairs", _meet([told], buckets, _make_cells))
    seen = kind(pairs, STATE).agg(F.sum("a").alias("once"), F.sum("b").alias("twice")).first()
    ratio, root_ratio = Stirling(discount_of(seen.once or 0, seen.twice or 0)), Stirling(discount_of(once, twice))
    cells, types = pairs, tokens
    news = kind(pairs, STATE).select(*_ROW.names).mapInArrow(_first_told(starts), _ROWS)
    tables, roots = float(v), []
    for turn in range(-1, BURN + KEEP):  # the first turn gives the start
        fresh = (ROOT_STRENGTH + root_ratio.discount * tables) / (v + 1)
        types = store("types", _meet([kind(types, STATE), news], buckets, _seat_roots(turn, fresh, root_ratio, starts), AT_ONCE))
        got = kind(types, STATE).agg(F.sum("a").alias("s"), F.sum("b").alias("own")).first()
        tables = float(got.s or 0)
        root = Root(root_ratio.discount, (ROOT_STRENGTH + root_ratio.discount * tables) / (v + 1), float(got.own or 0))
        roots += [root] if turn >= BURN else []
        cells = store("cells", _meet([kind(cells, STATE), kind(types, SUMS)], buckets, _seat_cells(turn, root, ratio, starts), AT_ONCE))
        news = kind(cells, TELL)

    values = store("values", _meet([kind(types, STATE), turned(ids, IDS)], buckets, _token_values).unionByName(
        _meet([kind(cells, STATE), turned(pairs, CLASSES)], buckets, _pair_values)))
    for name in ("pairs", "types", "cells"):
        store.drop(name)
    every = bodies.unionByName(ids.select("to", "kind", "frm", "body")).unionByName(values.select("to", "kind", "frm", "body"))
    dealt = every.repartition(tasks, "to").sortWithinPartitions("to", "kind", "frm")
    found = dealt.mapInArrow(_score_chunks(starts, ratio.discount, roots, n, v), "chunk bigint, at bigint, n_known bigint, base_score double, score double")
    out = texts.drop("body").join(found, ["chunk", "at"])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
