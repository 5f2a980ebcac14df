"""Larger inputs only add rows, blocks and tasks: the constants lowered, and what is a letter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import langid, mixing, vptree
from rowloom.llm.common import ensure_checkpoint_dir


def test_more_sources_and_blocks_than_a_broadcast_holds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 90))), None if k % 97 == 0 else f"s{k % 41}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.Mix(docs).digest().collect()))
    monkeypatch.setattr(mixing, "MOST_ROWS", 3)
    assert sorted(map(tuple, mixing.Mix(docs).digest().collect())) == want
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    monkeypatch.setattr(mixing, "WORDS_PER_SHARD", 2000)
    mix = mixing.Mix(docs)
    totals = {}
    for r in mix.digest().collect():
        assert r.taken <= 2 * r.size
        source = rows[r.doc_id][2]
        totals[source] = (totals.get(source, (0, 0))[0] + r.taken, r.target)
    assert mix.shards > 20 and all(abs(a - b) <= 1 for a, b in totals.values())


def test_parts_of_shards_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, vptree.nearest(rows, F.col("vec_id") % 20 == 0, shard_rows=40).collect()))
    monkeypatch.setattr(vptree, "MOST_SHARDS", 2)
    assert sorted(map(tuple, vptree.nearest(rows, F.col("vec_id") % 20 == 0, shard_rows=40).collect())) == want and len(want) == 45 * 5


def test_an_id_with_two_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.5, 0.5]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = vptree.nearest(rows, F.col("vec_id") == 1).collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 2), (2, 3)]
    again = [sorted(map(tuple, vptree.nearest(rows.repartition(n), F.col("vec_id") == 2).collect())) for n in (1, 3)]
    assert again[0] == again[1]


@pytest.mark.parametrize("text", ["\u00bd", "\u00b2 12", "\u2167", "_-", "", None])
def test_what_is_no_letter(spark, text):
    docs = spark.createDataFrame([(k, "hello there friend" if k % 2 else "bonjour mon ami", "en" if k % 2 else "fr") for k in range(40)] + [(99, text, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, F.col("doc_id") < 90, ["doc_id"]).collect()}
    assert (got[99].lang_pred, got[99].score) == ("und", 0.0) and got[1].lang_pred == "en"


def test_long_texts_are_counted_by_parts(monkeypatch):
    model = langid.fit(["hello there my friend", "bonjour mon cher ami"] * 20, ["en", "fr"] * 20)
    raw = np.frombuffer(("Bonjour, les amis. " * 300).encode(), np.uint8)
    whole = model.probabilities(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(langid, "CHUNK_BYTES", 64)
    assert np.allclose(model.probabilities(raw, np.array([0, len(raw)])), whole, atol=1e-4)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isDefined": lambda o: False})()})()})()

        def getConf(self):
            return Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context()})())
