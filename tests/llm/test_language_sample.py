"""Training texts count whole, and every language is learned."""

import numpy as np
from pyspark.sql import functions as F

from rowloom.llm import langid


def test_whole_texts_are_counted():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 3, 63, 64, 65, 1000):
        raw = bytes(rng.integers(65, 91, size, dtype=np.uint8))
        grams, _ = langid.subwords(*langid._flat([raw]))
        rows, times = np.unique(np.concatenate(grams), return_counts=True)
        got = langid.text_subwords(raw, 64)
        assert got[0].tolist() == rows.tolist() and got[1].tolist() == times.tolist()


def test_ends_of_long_texts_teach():
    """The two languages differ only behind the first MB."""
    same = "lorem ipsum dolor " * 60_000
    texts = [same + tail * 60_000 for tail in ("quux zork ", "fnord blip ") for _ in range(3)]
    model = langid.fit(texts, ["a"] * 3 + ["b"] * 3, epochs=40, rate=4.0)
    p = model.probabilities(*langid._flat([t.encode() for t in ("quux zork quux zork", "fnord blip fnord blip")]))
    assert p[0, 0] > 0.5 and p[1, 1] > 0.5


def test_every_language_is_sampled(spark):
    rows = [(i, f"text {i}", f"l{i % 300:03}") for i in range(900)] + [(i, "text", "big") for i in range(900, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.labelled_sample(docs, F.lit(True))
    assert len({lang for _, lang in got}) == 301
    assert len(langid.labelled_sample(docs, F.lit(True), sample=1)) <= 602


def test_embeddings_map_after_the_mean():
    rng = np.random.default_rng(3)
    table, weights, bias = rng.normal(size=(langid.BUCKETS, langid.WIDTH)), rng.normal(size=(langid.WIDTH, 40)), rng.normal(size=40)
    names = [f"l{k:02}" for k in range(40)]
    flat = langid._flat([b"some text", b"", b"another one"])
    late = langid.Model(names, table, bias, 1.5, 0.0, weights).probabilities(*flat)
    assert np.allclose(late, langid.Model(names, table @ weights, bias, 1.5, 0.0).probabilities(*flat))
