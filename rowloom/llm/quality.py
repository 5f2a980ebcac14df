"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good (1) or bad (0). Its features describe the line and both its neighbours: shares of byte classes, words
that repeat the word before, distinct words, lengths, and whether the document has had the line before. Training labels
are those of documents, passed to all their lines; weights of features and transitions maximize the penalized conditional
likelihood (forward-backward, Adam). A document's quality is the mean of its lines' marginals weighted by length, mapped
to the probability of label 1 by a logistic curve fitted on the sample at the classes' own frequencies.

The model is fitted on a bounded sample: SAMPLE documents of each label at most, chosen by hash. Prediction reads whole
texts, vectorized over all bytes and over all documents of a chunk, row by row without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import lower_ascii, text_chunks, word_hashes, words_of

SAMPLE, THRESHOLD = 1500, 0.7
CHUNK = 1 << 20
_CLASSES = ("\n", " \t\r\x0b\x0c", "".join(map(chr, range(97, 123))), "".join(map(chr, range(65, 91))), "0123456789", ".!?", ",;:'\"()-", "|", "#$%&*@^~_=+", "<>[]{}/\\`")
_CLASS_OF = np.full(256, len(_CLASSES) + 1, np.int64)  # other control bytes
_CLASS_OF[128:] = len(_CLASSES)
for _k, _letters in enumerate(_CLASSES):
    _CLASS_OF[[ord(c) for c in _letters]] = _k
N_CLASSES = len(_CLASSES) + 2
#: Features of one line: shares of all classes but the line end, then the seven named in line_features.
OWN = N_CLASSES - 1 + 7


def _own_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line its own features but the last one, its bytes and a hash; and the offsets of the documents among the lines.

    A document has a line more than line ends; an empty one has one line of no bytes.
    """
    docs, sizes = len(offsets) - 1, np.diff(offsets)
    text = np.full(len(raw) + docs, 0x0A, np.uint8)
    if len(raw):
        text[np.arange(len(raw)) + np.repeat(np.arange(docs), sizes)] = lower_ascii(raw)
    upper = np.zeros(len(text), bool)
    if len(raw):
        upper[np.arange(len(raw)) + np.repeat(np.arange(docs), sizes)] = (raw >= 65) & (raw <= 90)
    ends = np.flatnonzero(text == 0x0A)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lines = len(ends)
    line_of = np.repeat(np.arange(lines), ends - starts + 1)
    kinds = _CLASS_OF[text]
    kinds[upper] = 3
    shares = np.bincount(line_of * N_CLASSES + kinds, minlength=lines * N_CLASSES).reshape(lines, N_CLASSES)[:, 1:].astype(np.float64)
    size = (ends - starts).astype(np.float64)
    shares /= np.maximum(size, 1)[:, None]

    w_start, w_end, _ = words_of(text, np.array([0, len(text)]))
    hashes, owner = word_hashes(text, w_start, w_end), line_of[w_start]
    words = np.bincount(owner, minlength=lines).astype(np.float64)
    some = np.maximum(words, 1)
    repeat = np.zeros(len(hashes), bool)
    repeat[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    by_word = np.lexsort((hashes, owner))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[by_word][1:] != hashes[by_word][:-1]) | (owner[by_word][1:] != owner[by_word][:-1])
    distinct = np.bincount(owner[by_word], fresh, minlength=lines)
    marked = kinds[w_end - 1] == 8 if len(w_end) else np.zeros(0, bool)
    line_hash = np.zeros(lines, np.uint64)
    if len(hashes):
        seen = np.flatnonzero(words)
        line_hash[seen] = np.add.reduceat(hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(np.searchsorted(owner, seen), words[seen].astype(np.int64)).astype(np.uint64) + np.uint64(1)), np.searchsorted(owner, seen))
    doc_of = np.searchsorted(np.append(np.cumsum(sizes + 1), 0)[:-1], starts, "right")
    own = np.column_stack([
        shares, np.log1p(size) / 5, np.log1p(words) / 3, size / some / 20, np.bincount(owner, repeat, minlength=lines) / some,
        distinct / some, np.bincount(owner, marked, minlength=lines) / some, np.zeros(lines),
    ])
    return own, size, line_hash, np.searchsorted(doc_of, np.arange(docs + 1))


def _again(line_hash: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """1 for lines that their document has had before."""
    doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    by_line = np.lexsort((np.arange(len(line_hash)), line_hash, doc_of))
    out = np.zeros(len(line_hash))
    out[by_line[1:]] = (line_hash[by_line][1:] == line_hash[by_line][:-1]) & (doc_of[by_line][1:] == doc_of[by_line][:-1])
    return out


def _ends(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
    first[bounds[:-1]], last[bounds[1:] - 1] = True, True
    return first, last


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with those of its neighbours, bytes of each line, offsets of the documents among the lines)."""
    own, size, line_hash, bounds = _own_features(raw, offsets)
    own[:, -1] = _again(line_hash, bounds)
    first, last = _ends(bounds)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last, np.ones(len(size))]), size, bounds


def _parts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The chunk as it is, or one text of more than two chunks by parts that end before a line end (which is left out)."""
    if len(offsets) > 2 or len(raw) <= 2 * CHUNK:
        yield raw, offsets
        return
    lo = 0
    while lo <= len(raw):
        hi, step = min(len(raw), lo + CHUNK), 1 << 16
        while hi < len(raw):
            found = np.flatnonzero(raw[hi : hi + step] == 0x0A)
            hi += int(found[0]) if len(found) else min(step, len(raw) - hi)
            if len(found):
                break
        yield raw[lo:hi], np.array([0, hi - lo])
        lo = hi + 1


def _products(m: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of 2 x 2 matrices (rows 00, 01, 10, 11 of m) the product of each with all before it in its segment, up to a factor.

    A scan by doubling: matrices whose place in their segment is `step` or more take in those `step` places back.
    """
    step, active = 1, np.flatnonzero(place >= 1)
    while len(active):
        a, b, c, d = m[:, active]
        e, f, g, h = m[:, active - step]
        new = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h])
        m[:, active] = new / new.max(axis=0)
        step *= 2
        active = active[place[active] >= step]
    return m


def forward_backward(emission: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good against bad for each line, from all lines before it (with it) and from all after it.

    Memory and work go with the number of lines, whatever the lengths of the documents.
    """
    counts = np.diff(bounds)
    place = np.arange(len(emission)) - np.repeat(bounds[:-1], counts)
    from_end = np.repeat(counts, counts) - 1 - place
    e = np.clip(emission, -300, 300)
    bad, good = np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))
    (t00, t01), (t10, t11) = np.exp(trans)
    inner, nothing = place > 0, np.zeros(len(e))
    m = np.stack([np.where(inner, t00, 1) * bad, np.where(inner, t10, 0) * bad, np.where(inner, t01, 0) * good, np.where(inner, t11, 1) * good])
    a, b, c, d = _products(m, place)
    forward = np.log(np.maximum(c + d, 1e-300)) - np.log(np.maximum(a + b, 1e-300))
    inner = from_end > 0
    bad, good = np.append(bad[1:], 1), np.append(good[1:], 1)
    m = np.stack([np.where(inner, t00 * bad, 1), np.where(inner, t01 * good, nothing), np.where(inner, t10 * bad, nothing), np.where(inner, t11 * good, 1)])
    a, b, c, d = _products(np.ascontiguousarray(m[:, ::-1]), from_end[::-1])[:, ::-1]
    return forward, np.log(np.maximum(c + d, 1e-300)) - np.log(np.maximum(a + b, 1e-300))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float
    prior: float  # score of texts without a byte

    def marks(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean marginal by length, and number of bytes in lines, of each document."""
        # emissions part by part: a line's own features times the weights that it, the line after and the line before have for them
        w = self.weights / self.scale
        by_place = w[: 3 * OWN].reshape(3, OWN)
        found = [(own @ by_place.T, size, line_hash, bounds) for own, size, line_hash, bounds in (_own_features(*p) for p in _parts(raw, offsets))]
        effect, size, line_hash = (np.concatenate([f[i] for f in found]) for i in range(3))
        bounds = found[0][3] if len(found) == 1 else np.array([0, len(size)])
        effect += _again(line_hash, bounds)[:, None] * by_place[:, -1]
        first, last = _ends(bounds)
        e = effect[:, 0] + np.where(first, w[-3], np.roll(effect[:, 1], 1)) + np.where(last, w[-2], np.roll(effect[:, 2], -1)) + w[-1] - self.mean @ w
        forward, backward = forward_backward(e, bounds, self.trans)
        total = np.add.reduceat(size, bounds[:-1]) if len(size) else size
        return np.add.reduceat(_sigmoid(forward + backward) * size, bounds[:-1]) / np.maximum(total, 1), total

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        mark, total = self.marks(raw, offsets)
        mark = np.clip(mark, 1e-6, 1 - 1e-6)
        return np.where(total > 0, _sigmoid(self.slope * np.log(mark / (1 - mark)) + self.shift), self.prior)


def fit(texts: list[str], labels: list[int], weights: list[float], rounds: int = 80, penalty: float = 2e-3) -> Model:
    """A model of labelled documents; weights restore the frequency of each label."""
    y_doc, w_doc = np.array(labels, float), np.array(weights, float)
    prior = float((w_doc * y_doc).sum() / w_doc.sum())
    # features chunk by chunk: only they are held for all documents, not what they are made of
    parts = [line_features(raw, offsets) for _, _, raw, offsets in text_chunks(pa.array(texts, pa.large_string()))]
    x, size = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    ends = np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))
    bounds = np.concatenate(([0], ends))
    del parts
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[scale < 1e-6] = 0, 1
    x = (x - mean) / scale
    counts = np.diff(bounds)
    y = np.repeat(y_doc, counts)
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    weight, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = np.array([[((y[at - 1] == i) & (y[at] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    moment = [np.zeros(len(weight) + 4), np.zeros(len(weight) + 4)]
    for k in range(1, rounds + 1):
        e = x @ weight
        forward, backward = forward_backward(e, bounds, trans)
        p = _sigmoid(forward + backward)
        # pairs of neighbouring lines: (before, after) as log weights, in the order 00, 01, 10, 11
        pair = np.stack([np.full(len(at), trans[0, 0]), trans[0, 1] + e[at] + backward[at], trans[1, 0] + forward[at - 1], trans[1, 1] + forward[at - 1] + e[at] + backward[at]])
        pair = np.exp(pair - pair.max(axis=0)) if len(at) else pair
        pair /= pair.sum(axis=0)
        up = np.concatenate([x.T @ (y - p), (seen.ravel() - pair.sum(axis=1))]) / len(y)
        up -= penalty * np.concatenate([weight, trans.ravel()])
        moment[0] = 0.9 * moment[0] + 0.1 * up
        moment[1] = 0.99 * moment[1] + 0.01 * up * up
        move = 0.1 * (moment[0] / (1 - 0.9**k)) / (np.sqrt(moment[1] / (1 - 0.99**k)) + 1e-8)
        weight, trans = weight + move[:-4], trans + move[-4:].reshape(2, 2)
    model = Model(mean, scale, weight, trans, 1.0, 0.0, prior)
    # calibration: weighted logistic regression of the label on the log odds of the mean marginal, by Newton steps
    mark = np.clip(np.add.reduceat(_sigmoid(np.add(*forward_backward(x @ weight, bounds, trans))) * size, bounds[:-1]) / np.maximum(np.add.reduceat(size, bounds[:-1]), 1), 1e-6, 1 - 1e-6)
    z, ab = np.column_stack([np.log(mark / (1 - mark)), np.ones(len(mark))]), np.array([1.0, 0.0])
    w = w_doc / w_doc.mean()
    for _ in range(25):
        p = _sigmoid(z @ ab)
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2) * len(w) / 100
        ab = ab + np.linalg.solve(hess, z.T @ (w * (y_doc - p)) - 0.05 * (ab - [1.0, 0.0]) * len(w) / 100)
    model.slope, model.shift = max(1e-3, float(ab[0])), float(ab[1])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", sample: int = SAMPLE) -> list[tuple[str, int, float]]:
    """(text, label, weight) of about `sample` documents of each label. The chosen ids, at most 4 * sample rows, are broadcast."""
    known = labels.where(train & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    counts = {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    rate = F.lit(0.0)
    for k, n in counts.items():
        rate = F.when(F.col("__label") == k, min(1.0, sample / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit(13), "__id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < rate).orderBy(draw, "__id", "__label").limit(4 * sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id").where("__text IS NOT NULL")
    found = [(r["__text"], r["__label"]) for r in rows.orderBy(draw, F.xxhash64("__text"), "__label").limit(8 * sample).collect()]
    had = {k: sum(1 for _, x in found if x == k) for k in counts}
    return [(t, k, counts[k] / had[k]) for t, k in found]


def score(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of keep and score (probability of label 1) for every row; null and empty texts score the labels' share of 1.

    No model (no labels): 0.5. Row by row: no shuffle; repeated rows and null ids pass through.
    """
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            for lo, hi, raw, offsets in text_chunks(batch.column(batch.num_columns - 1), CHUNK) if model else ():
                out[lo:hi] = model.scores(raw, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "score"])

    return slim.mapInArrow(run, ", ".join([*kinds, "score double"]))


def train_model(docs: DataFrame, labels: DataFrame, train: Column, **names) -> Model | None:
    """None unless the sample has both labels."""
    sample = labelled_sample(docs, labels, train, **names)
    return fit(*map(list, zip(*sample, strict=True))) if len({s[1] for s in sample}) == 2 else None


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, columns as they are, whose score is `threshold` or more. Without a model all rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, raw, offsets in text_chunks(batch.column(place), CHUNK) if model else ():
                keep[lo:hi] = model.scores(raw, offsets) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
