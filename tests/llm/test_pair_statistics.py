"""The language model against a brute-force version, its contract's columns, and input that is awkward."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rowloom.llm import pitmanyor
from rowloom.llm.common import word_hashes

WORDS = "\t\n\x0b\x0c\r "


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*low.translate({ord(c): " " for c in WORDS}).split(" "), None]


def tokens_of(text):
    return [t for t in tokens(text) if t != ""]


def hash_of(token):
    raw = np.frombuffer((token or "").encode(), np.uint8)
    return int(pitmanyor.END) if token is None else int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


class Plain:
    """The same restaurants in dictionaries and whole arrays, without chunks, buckets or messages."""

    def __init__(self, texts, train):
        self.number = {t: i for i, t in enumerate(sorted({t for x in texts for t in tokens_of(x)}, key=hash_of))}
        taught = [tokens_of(x) for x, y in zip(texts, train, strict=True) if y]
        self.c = np.zeros(len(self.number), np.int64)
        pairs = Counter()
        for x in taught:
            for u, w in zip([None, *x], x, strict=False):
                pairs[self.number[u], self.number[w]] += 1
                self.c[self.number[w]] += 1
        every = sorted(pairs)
        u, w, c = (np.array([p[i] for p in every], np.int64) for i in (0, 1)), None, None
        (u, w), c = u, np.array([pairs[p] for p in every], np.int64)
        n, self.v = len(self.number), int((self.c > 0).sum())
        self.d = pitmanyor.discount_of((c == 1).sum(), (c == 2).sum())
        root_d = pitmanyor.discount_of((self.c == 1).sum(), (self.c == 2).sum())
        ratio, root_ratio = pitmanyor.Stirling(self.d), pitmanyor.Stirling(root_d)
        keys = pitmanyor.mix64((u.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64))
        root_keys = pitmanyor.mix64(np.arange(n, dtype=np.uint64) + np.uint64(77))
        t, s, roots, self.kept = np.ones(len(c), np.int64), self.c.copy(), float(self.v), []
        for turn in range(-1, pitmanyor.BURN + pitmanyor.KEEP):
            tables, own = np.bincount(u, t, n).astype(np.int64), np.bincount(w, t, n).astype(np.int64)
            weight = np.full(n, (1 + root_d * roots) / (self.v + 1))
            s = pitmanyor.start_tables(own, weight, root_d) if turn < 0 else np.clip(s, np.minimum(own, 1), own)
            s = pitmanyor.gibbs(own, s, weight, root_keys, root_ratio, turn + 1)
            roots = float(s.sum())
            chance = (own - root_d * s + (1 + root_d * roots) / (self.v + 1)) / (1 + own.sum())
            if turn >= pitmanyor.BURN:
                self.kept.append((dict(zip(every, (c - self.d * t).tolist(), strict=True)), tables, chance))
            a = (1 + self.d * tables[u]) * chance[w]
            t = pitmanyor.start_tables(c, a, self.d) if turn < 0 else pitmanyor.gibbs(c, t, a, keys, ratio, turn)

    def p(self, before, token):
        u, w = self.number[before], self.number[token]
        return np.mean([(own.get((u, w), 0) + (1 + self.d * tables[u]) * chance[w]) / (1 + self.c[u]) for own, tables, chance in self.kept])

    def score(self, text):
        x = tokens_of(text)
        return sum(log10(self.p(u, w)) for u, w in zip([None, *x], x, strict=False))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=np.arange(40, 0, -1) / 820)) for _ in range(60)]
    return [*texts, texts[0], texts[1], texts[1], "A a\tA\n", "", None, "only here", "caf\u00e9 \u00a0x"]


@pytest.mark.parametrize("chunk", [64, 1 << 22])
def test_against_plain_version(spark, corpus, chunk):
    train = [i % 3 != 0 for i in range(len(corpus))]
    docs = spark.createDataFrame(list(zip(range(len(corpus)), corpus, train, strict=True)), "doc_id long, text string, train boolean")
    rows = {r.doc_id: r for r in pitmanyor.scores(docs, F.col("train"), ["doc_id"], chunk=chunk).collect()}
    plain = Plain(corpus, train)
    n = int(plain.c.sum())
    for i, x in enumerate(corpus):
        got, c = rows[i], [int(plain.c[plain.number[t]]) for t in tokens_of(x)]
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(c), sum(k > 0 for k in c), n)
        assert got.base_score == pytest.approx(sum(log10((k + 1) / (n + plain.v + 1)) for k in c))
        assert got.score == pytest.approx(plain.score(x), rel=1e-5)


def test_predictions_sum_to_one(corpus):
    train = [i % 3 != 0 for i in range(len(corpus))]
    plain = Plain(corpus, train)
    taught = [t for t in plain.number if plain.c[plain.number[t]]]
    for u in plain.number:
        unseen = np.mean([(1 + plain.d * tables[plain.number[u]]) * chance[plain.number["here"]] / (1 + plain.c[plain.number[u]]) for _, tables, chance in plain.kept])
        assert sum(plain.p(u, w) for w in taught) + unseen == pytest.approx(1)


def test_contract_and_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = {r.doc_id: r for r in entry.queries()["op10_lm_score"](spark, sf).collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    c = Counter(t for r in docs if not held[r.doc_id] for t in tokens_of(r.text))
    n, v = sum(c.values()), len(c)
    assert set(rows) == set(held)
    for r in docs:
        x, got = tokens_of(r.text), rows[r.doc_id]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (held[r.doc_id], len(x), sum(c[t] > 0 for t in x), n)
        assert got.base_score == pytest.approx(sum(log10((c[t] + 1) / (n + 1 * (v + 1))) for t in x))
        assert got.score < 0
    better = [rows[i].score - rows[i].base_score for i in held if held[i]]
    assert sum(better) > 0.05 * -sum(rows[i].base_score for i in held if held[i])


def test_awkward_rows(spark):
    shape = "doc_id long, text string, chunk string, score string, k0 string"
    rows = [(None, "a b", "x", "y", "z"), (1, None, None, None, None), (1, None, None, None, None), (2, "", "", "", ""), (3, "a " * 5000, "x", "y", "z"), (4, "q" * 70_000, "x", "y", "z")]
    docs = spark.createDataFrame(rows, shape)
    got = pitmanyor.scores(docs, F.col("doc_id") != 3, ["doc_id", "chunk", "k0"]).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 1), ("1", 1), ("2", 1), ("3", 5001), ("4", 2), ("None", 3)]
    assert all(np.isfinite(r.score) for r in got) and got[0].train_tokens == 5
    assert pitmanyor.scores(docs.limit(0), F.lit(True), ["doc_id"]).count() == 0
    none = pitmanyor.scores(docs, F.lit(False), ["doc_id"]).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.score) < 1e-9 for r in none)


def test_packed_arrays_come_back():
    rng = np.random.default_rng(0)
    for x in (np.zeros(0, np.int64), rng.integers(0, 1 << 63, 999, np.uint64), np.sort(rng.integers(0, 1 << 40, 999)), rng.random(7), rng.random(5).astype(np.float32), np.array([3], np.uint8)):
        (y,) = pitmanyor.unpack(pitmanyor.pack(x))
        assert y.dtype == x.dtype and (x == y).all()
    x = rng.integers(0, 1 << 63, 999, np.uint64)
    assert (pitmanyor.unmix64(pitmanyor.mix64(x)) == x).all()


def test_long_text_by_parts(monkeypatch):
    raw = np.frombuffer(("one two  three\nfour " * 50).encode(), np.uint8)
    whole = pitmanyor.tokens_of(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(pitmanyor, "CHUNK", 16)
    parts = pitmanyor.tokens_of(raw, np.array([0, len(raw)]))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_sweeps_forget_their_start():
    c = np.full(400, 100_000)
    keys = pitmanyor.mix64(np.arange(400, dtype=np.uint64))
    ratio, a = pitmanyor.Stirling(0.5), np.full(400, 30.0)
    low, high = np.full(400, 1), np.full(400, 30_000)
    for turn in range(30):
        low, high = (pitmanyor.gibbs(c, t, a, keys, ratio, turn) for t in (low, high))
    assert abs(low.mean() / high.mean() - 1) < 0.1
    once = pitmanyor.gibbs(c, np.full(400, 30_000), a, keys, ratio, 0)
    assert 30_000 - once.mean() > 1_000
