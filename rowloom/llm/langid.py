"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with calibrated rejection.

Subwords are the byte n-grams (2 to 4) of a text between two spaces, ASCII lower-cased; each hashes to a row of an
embedding table, a text is the mean of its rows, and a softmax over a linear map of it gives the languages. As map and mean
commute, prediction reads the rows already mapped: one small table, one pass over the bytes of whole texts.

The model is fitted on a bounded sample of labelled rows (SAMPLE documents per language and about MOST_ROWS in all, but some
of every language): ids are chosen by hash at a rate that their counts give. Where there are more languages than WIDTH, the
embeddings are kept and mapped after the mean, so the table doesn't grow with the languages. A part of the sample sets the temperature of the softmax
and the least probability at which a prediction is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import CHUNK_BYTES, lower_ascii, text_chunks

BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (2, 3, 4)
SAMPLE, MOST_ROWS = 400, 80_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")  # by Unicode category: no fractions, exponents or Roman numerals
_KEYS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _buckets(codes: np.ndarray, n: int) -> np.ndarray:
    h = codes[: len(codes) - n + 1] * _KEYS[0]
    for k in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * _KEYS[k] + codes[k : len(codes) - n + 1 + k]
    return (h ^ (h >> np.uint32(16))) & np.uint32(BUCKETS - 1)


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the texts in raw, text by text, and the offsets of the texts among them. Empty texts have one of one space pair."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    padded = np.full(len(raw) + 2 * rows, 0x20, np.uint8)
    if len(raw):
        padded[np.arange(len(raw)) + 2 * np.repeat(np.arange(rows), sizes) + 1] = lower_ascii(raw)
    first = offsets[:-1] + 2 * np.arange(rows)
    grams, owners = [], []
    codes = padded.astype(np.uint32) + np.uint32(1)
    end = np.repeat(first + sizes + 2, sizes + 2)
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = _buckets(codes, n)
        start = np.flatnonzero(np.arange(len(h)) + n <= end[: len(h)])
        grams.append(h[start].astype(np.int32))
        owners.append(start)
    return grams, [np.searchsorted(o, np.append(first, len(padded))) for o in owners]


def text_subwords(raw: bytes, most: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of one text and how often each occurs, counted `most` bytes at a time."""
    padded = np.frombuffer(b" " + raw.lower() + b" ", np.uint8)
    rows, times = [], []
    for at in range(0, len(padded), most):
        codes = padded[at : at + most + max(GRAMS) - 1].astype(np.uint32) + np.uint32(1)
        hashed = [_buckets(codes, n)[:most] for n in GRAMS if len(codes) >= n]
        found, n = np.unique(np.concatenate([h.astype(np.int32) for h in hashed] or [np.zeros(0, np.int32)]), return_counts=True)
        rows.append(found)
        times.append(n)
    if len(rows) == 1:
        return rows[0], times[0]
    rows, place = np.unique(np.concatenate(rows), return_inverse=True)
    return rows, np.bincount(place, np.concatenate(times)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, langs): embeddings already mapped to the languages; or (BUCKETS, WIDTH) if weights map them
    bias: np.ndarray
    temperature: float
    least: float  # predictions of a lower probability are rejected
    weights: np.ndarray | None = None  # (WIDTH, langs)

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total, count = np.zeros((rows, self.table.shape[1])), np.zeros(rows)
        if rows == 1 and len(raw) > 2 * CHUNK_BYTES:  # one long text: counted part by part
            grams, times = text_subwords(raw.tobytes())
            total[0], count[0] = times @ self.table[grams], times.sum()
        else:
            for grams, bounds in zip(*subwords(raw, offsets), strict=True):
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    total[some] += np.add.reduceat(self.table[grams], bounds[:-1][some], axis=0)
                    count[some] += np.diff(bounds)[some]
        mean = total / np.maximum(count, 1)[:, None]
        logits = ((mean if self.weights is None else mean @ self.weights) + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def fit(texts: list[str], langs: list[str], epochs: int = 8, rate: float = 1.0, accept: float = 0.99, seed: int = 3) -> Model:
    """A model of labelled texts. Each epoch sees every training text and a random cut of it, so short texts work too."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(order) // 5] if len(order) >= 20 else order
    train = order[len(order) // 5 :] if len(order) >= 20 else order
    place = {x: i for i, x in enumerate(names)}
    label = np.array([place[x] for x in langs])
    raws = [t.encode() for t in texts]

    def example(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        rows, times = text_subwords(raw)
        return rows, (times / times.sum()).astype(np.float32)

    def cut(raw: bytes) -> bytes:
        n = int(rng.integers(12, 160))
        at = int(rng.integers(0, max(1, len(raw) - n)))
        return raw[at : at + n]

    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    whole = {i: example(raws[i]) for i in train}
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            for rows, share in (whole[i], example(cut(raws[i]))):
                hidden = share @ table[rows]
                z = hidden @ weights + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label[i]] -= 1
                back = weights @ p
                weights -= step * np.outer(hidden, p)
                bias -= step * 0.1 * p
                table[rows] -= step * 16 * share[:, None] * back
    few = len(names) <= WIDTH
    model = Model(names, (table @ weights).astype(np.float32) if few else table, bias.astype(np.float64), 1.0, 0.0, None if few else weights)

    # calibration: held-out texts and cuts of them set the temperature, then the least probability that is right often enough
    probes = [raws[i] for i in held] + [cut(raws[i]) for i in held]
    truth = np.concatenate((label[held], label[held]))
    if len(probes) and len(names) > 1:
        logits = np.log(np.maximum(model.probabilities(*_flat(probes)), 1e-30))
        loss = {}
        for t in np.geomspace(0.05, 20, 60):
            scaled = logits / t
            scaled -= scaled.max(axis=1, keepdims=True)
            loss[t] = -(scaled[np.arange(len(truth)), truth] - np.log(np.exp(scaled).sum(axis=1))).mean()
        model.temperature = float(min(loss, key=loss.get))
        p = model.probabilities(*_flat(probes))
        best, right = p.max(axis=1), p.argmax(axis=1) == truth
        down = np.argsort(-best)
        good = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= accept)
        model.least = float(best[down[good[-1]]]) if len(good) else 1.0
    return model


def labelled_sample(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, lang) of about `sample` rows per language, MOST_ROWS in all, among the rows that `train` holds for: chosen by a
    hash of the id. A language has the row of its least hash at least, whatever the number of languages."""
    labelled = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1 << 30)) / float(1 << 30)
    counts = labelled.groupBy(lang_col).agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()  # a row per language
    if not counts:
        return []
    sample = min(sample, max(1, MOST_ROWS // len(counts)))
    bounds = [(r[0], max(sample / r.n, r.least)) for r in counts]
    bounds = docs.sparkSession.createDataFrame(bounds, "__lang string, __most double")
    rows = labelled.join(F.broadcast(bounds), F.col(lang_col) == F.col("__lang")).where(draw <= F.col("__most"))
    rows = rows.select(text_col, lang_col, draw.alias("__draw")).orderBy("__draw", F.xxhash64(text_col), lang_col).limit(2 * sample * len(counts))
    return [tuple(r)[:2] for r in rows.collect()]


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of keep and lang_pred, score, accepted for every row, over whole texts.

    lang_pred: the likeliest language; und (score 0, not accepted) for null texts, texts without a letter, or no model.
    Ties go to the language first in order. Row by row: no shuffle; repeated rows and null ids pass through.
    """
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score, accepted = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
            for lo, hi, raw, offsets in text_chunks(batch.column(batch.num_columns - 1)) if model else ():
                best = model.probabilities(raw, offsets)
                which, top = best.argmax(axis=1), best.max(axis=1)
                for r in range(hi - lo):
                    if _LETTER.search(raw[offsets[r] : offsets[r + 1]].tobytes().decode()):
                        lang[lo + r], score[lo + r], accepted[lo + r] = model.langs[which[r]], top[r], top[r] >= model.least
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], [*batch.schema.names[:-1], "lang_pred", "score", "accepted"]
            )

    return slim.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double, accepted boolean"]))


def identify(docs: DataFrame, train: Column, keep: list[str], text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """predict() by a model of the rows that `train` holds for."""
    sample = labelled_sample(docs, train, text_col, lang_col, id_col)
    return predict(docs, fit(*map(list, zip(*sample, strict=True))) if sample else None, keep, text_col)
