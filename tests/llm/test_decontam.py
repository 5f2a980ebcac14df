"""Benchmark decontamination against a brute-force version, its proximity matches, and awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rowloom.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            v = words(t)
            wide = min(window, len(v))
            for s in range(len(v) - wide + 1 if v else 0):
                for p in range(len(w) - wide + 1):
                    if w[p : p + wide] == v[s : s + wide]:
                        hit |= set(range(p, p + wide))
                        ids |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(w), len(hit), tuple(sorted(ids)), bool(hit)))
    return sorted(out, key=repr)


def ours(spark, docs, items, **options):
    found = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options)
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_brute_force(spark, seed):
    draw = random.Random(seed)
    letters = ["a", "B", "c", "É", "ß", "x9", "the", "日本"]
    text = lambda n: draw.choice(["", " ", "."]) + draw.choice([" ", "\n", "-"]).join(draw.choice(letters) for _ in range(n)) + draw.choice(["", "!"])
    items = [(i, text(draw.choice([1, 3, 5, 6, 9]))) for i in range(12)] + [(1, text(7)), (None, text(2))]
    docs = [(i, text(draw.choice([0, 1, 4, 30, 80]))) for i in range(25)]
    docs += [(100 + k, text(10) + " " + t + " " + text(10)) for k, (_, t) in enumerate(items)] + docs[:3]
    assert ours(spark, docs, items, window=4) == brute(docs, items, 4)


def test_windows_of_ten(spark):
    item = "One two three four five six seven eight nine ten eleven twelve"
    docs = [(1, "x " + item.upper() + " y"), (2, "one two three four five six seven eight nine"), (3, "two three four five, six. seven eight nine ten ELEVEN"), (4, item.replace("six", "sixth")), (5, item + " " + item)]
    assert ours(spark, docs, [(7, item)]) == brute(docs, [(7, item)])
    assert [r[2] for r in brute(docs, [(7, item)])] == [12, 0, 10, 0, 24]


def test_runs_of_one_word_and_long_texts(spark):
    items = [(1, "the " * 40), (2, "the the"), (3, "rare " + "the " * 15)]
    docs = [(1, "the " * 300), (2, "the"), (3, "so rare " + "the " * 9), (4, "word " * 30_000 + "the the " + "word " * 30_000)]
    assert ours(spark, docs, items) == brute(docs[:3], items) + [(4, 60_002, 2, ("2",), True)]


def test_awkward_rows(spark):
    docs = [(None, None), (1, ""), (1, ""), (2, "?! --"), (None, "a b c"), (3, "a b c")]
    items = [(None, None), (4, ""), (5, "A, b"), (5, "a b"), (6, "b c"), (None, "c")]
    assert ours(spark, docs, items) == brute(docs, items)
    assert ours(spark, docs, []) == brute(docs, [])
    assert ours(spark, [], items) == []


def test_clashing_columns_stay_or_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "own", 9)], "doc_id long, text string, items string, n_words long").withColumnRenamed("items", "k1")
    got = decontam.contamination(docs, spark.createDataFrame([(1, "b")], ITEMS)).collect()[0]
    assert (got.k1, got.n_words, got.n_hit, got["items"]) == ("own", 2, 1, ["1"])


def test_proximity(spark):
    docs = [(1, "p q r alpha s beta t"), (2, "alpha beta p q r s t"), (3, "beta x y alpha"), (4, "alpha s s s beta"), (5, "s t s t p q r p q r s t s t")]
    index = decontam.Index.build(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "alpha s beta")], ITEMS))
    names = {tuple(r) [:2]: r[2] for r in spark.createDataFrame(docs, DOCS).select(*decontam.text_key(F.col("text")), "doc_id").collect()}
    of = lambda slack: sorted((names[r.k1, r.k2], r.start, r.gap) for r in index.near(slack).collect())
    assert of(0) == [(1, 3, 0)]
    # the gap moves the second term; which of two equally rare terms is first depends on their place alone
    assert [(d, abs(g)) for d, _, g in of(2)] == [(1, 0), (2, 1), (4, 2)]


def test_query_columns(spark, sf):
    found = queries.op11_decontamination(spark, sf)
    assert [c for c, _ in found.dtypes][:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = found.collect()
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)
    assert {r.items_sha256 for r in rows if not r.contaminated} == {hashlib.sha256(b"").hexdigest()}
