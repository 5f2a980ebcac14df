"""Embedding whitening by hierarchical merging of singular value decompositions, which keeps every dimension.

A chunk of vectors is centred and decomposed; what it leaves is its row count, exact component sums, and the full-rank
product of singular values and right vectors (at most d x d numbers). Two such states merge by stacking both products and one
row for the distance of their means, and decomposing again, which loses nothing: the merged product has the scatter of all
rows. Chunks merge within a partition, partitions in a tree of groups, so no task or driver holds more than a few states.

Entries are taken in fixed point, floor(SCALE * c) + OFFSET, so sums and deviations are exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import cut

SCALE, OFFSET = 1024, 100_000
#: Vectors with a larger entry take no part: their sums would no longer be exact.
MOST = float(1 << 40)
#: States that one merge takes; rows that one decomposition takes.
FAN, ROWS = 16, 4096
_LOW = 25
_STATE = "part long, n long, high array<long>, low array<long>, basis array<double>"
_ARROW_STATE = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("basis", pa.list_(pa.float64()))])


@dataclass
class State:
    """n rows: their exact sums, and a basis B with B'B = the sum of squares and products about their mean."""

    n: int
    sums: list[int]
    basis: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        n, sums = len(x), [int(h) * (1 << _LOW) + int(v) for h, v in zip((x >> _LOW).sum(0), (x & ((1 << _LOW) - 1)).sum(0), strict=True)]
        return cls(n, sums, _decomposed(centred(x, n, sums)))

    def merged(self, other: State) -> State:
        n = self.n + other.n
        apart = np.array([float(a * other.n - b * self.n) for a, b in zip(self.sums, other.sums, strict=True)]) / (float(self.n) * other.n)
        correction = np.sqrt(float(self.n) * other.n / n) * apart
        return State(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], _decomposed(np.vstack([self.basis, other.basis, correction[None]])))

    def row(self) -> dict:
        high, low = [s >> _LOW for s in self.sums], [s & ((1 << _LOW) - 1) for s in self.sums]
        return {"n": self.n, "high": high, "low": low, "basis": self.basis.ravel().tolist()}

    @classmethod
    def read(cls, n, high, low, basis) -> State:
        return cls(int(n), [int(h) * (1 << _LOW) + int(v) for h, v in zip(high, low, strict=True)], np.array(basis, np.float64).reshape(-1, len(high)))


def _decomposed(a: np.ndarray) -> np.ndarray:
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    return s[:, None] * vt


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x minus sums / n as doubles: whole parts are subtracted as whole numbers, so large means cost no digits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def fixed_point(vectors: pa.Array, d: int) -> np.ndarray:
    """Rows of whole numbers from a list column of d doubles each."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * values).astype(np.int64) + OFFSET


def usable(vector: Column, d: int | None = None) -> Column:
    """Whether a vector takes part: not null or empty, no entry null, not finite or beyond MOST, and of d entries."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c) <= MOST, F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound & ((F.size(vector) == d) if d else F.lit(True)), F.lit(False))


@dataclass
class Model:
    """All components of the fit list: n, exact sums, unit directions (rows, by falling variance) and their variances."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def scale(self, top: int) -> np.ndarray:
        """Directions over their standard deviations, a column each; 0 for a direction without variance."""
        dev = np.sqrt(self.variances[:top])
        return self.directions[:top].T * np.where(dev > 0, 1 / np.where(dev > 0, dev, 1), 0)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exact; None where it is too large for a long.

        Arithmetic modulo 2^64 is right for all sums below 2^63; doubles tell which those are, whole numbers settle the border.
        """
        about = (centred(x, self.n, self.sums) ** 2).sum(1) * float(self.n) ** 2
        shift = np.array([s % (1 << 64) for s in self.sums], np.uint64)
        gap = np.uint64(self.n) * x.astype(np.uint64) - shift
        exact = (gap * gap).sum(1, dtype=np.uint64)
        out: list[int | None] = [int(v) for v in exact]
        most = float(1 << 63)
        for i in np.flatnonzero(about > most * (1 - 1e-6)):
            value = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums, strict=True)) if about[i] < most * (1 + 1e-6) else 1 << 63
            out[i] = value if value < 1 << 63 else None
        return out


def dimension(df: DataFrame, vector: str) -> int | None:
    """The commonest length of usable vectors, of equally common ones the longest; None without any."""
    sizes = df.where(usable(F.col(vector))).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sizes["d"] if sizes else None


def fit(df: DataFrame, vector: str = "embedding") -> Model | None:
    """The model of all usable vectors of df; None if there are none. Vectors of another length than the commonest take no part."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v"))
    d = dimension(rows, "v")
    if d is None:
        return None

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for batch in batches:
            x = fixed_point(batch.column(0), d)
            for at in range(0, len(x), ROWS):
                part = State.of(x[at : at + ROWS])
                state = part if state is None else state.merged(part)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId()} | state.row()], _ARROW_STATE)

    def group(states: pd.DataFrame) -> pd.DataFrame:
        merged = None
        for r in states.sort_values("part").itertuples():
            state = State.read(r.n, r.high, r.low, r.basis)
            merged = state if merged is None else merged.merged(state)
        return pd.DataFrame([{"part": int(states["part"].min()) // FAN} | merged.row()])

    states = cut(rows.where(usable(F.col("v"), d)).mapInArrow(partition, _STATE))
    most = states.agg(F.max("part")).first()[0]
    while most:
        states, most = states.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(group, _STATE), most // FAN
    last = states.select("n", "high", "low", "basis").first()
    final = State.read(*last)
    _, s, vt = np.linalg.svd(np.vstack([final.basis, np.zeros((max(0, d - len(final.basis)), d))]))
    s = np.where(s > s[0] * d * np.finfo(float).eps, s, 0.0)
    strongest = np.abs(vt).argmax(1)
    vt *= np.sign(vt[np.arange(d), strongest])[:, None]
    return Model(final.n, final.sums, vt, s * s / final.n)


def transform(df: DataFrame, model: Model, top: int, vector: str = "embedding", keys: list[str] | None = None) -> DataFrame:
    """(keys, deviation, whitened array<double>) for the usable rows of df: their first `top` whitened components."""
    keys = keys or []
    scale, schema = model.scale(top), df.select(*keys).schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "deviation long", "whitened array<double>"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = fixed_point(batch.column(len(keys)), model.dimension)
            w = centred(x, model.n, model.sums) @ scale
            bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * scale.shape[1])
            columns = [*batch.columns[: len(keys)], pa.array(model.deviation(x), pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(w.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "deviation", "whitened"])

    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("__v"))
    return rows.where(usable(F.col("__v"), model.dimension)).mapInArrow(apply, fields)


def identity_error(whitened: DataFrame, live: int) -> float:
    """Largest absolute entry of the covariance (divisor n) of the first `live` whitened components minus the identity."""
    if not live:
        return 0.0
    at = [(i, j) for i in range(live) for j in range(i, live)]
    row = whitened.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in at]).first()
    return float(max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in at))


def whiten(df: DataFrame, key: str, top: int = 8, vector: str = "embedding") -> DataFrame:
    """(key, component from 1, n, deviation, whitened, explained, identity_error): a row per usable vector and component up to `top`.

    Vectors that are null, empty, or hold an entry that is null, not finite or beyond MOST take no part, nor do those of another
    length than the commonest. Repeated rows and null keys have rows of their own. A component without variance (fewer rows
    than dimensions, constant entries) has whitened 0 and explains 0, and the identity is over the others. Deviations that a
    long can't hold are null. No usable vector gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    model = fit(df, vector)
    if model is None:
        shape = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], shape)
    top = min(top, model.dimension)
    live, trace = int((model.variances[:top] > 0).sum()), float(model.variances.sum())
    rows = transform(df, model, top, vector, [key])
    error = identity_error(rows, live)
    explained = F.array(*[F.lit(float(v / trace) if trace else 0.0) for v in model.variances[:top]])
    long = rows.select(key, "deviation", F.posexplode("whitened").alias("at", "w"))
    return long.select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
