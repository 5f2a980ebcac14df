"""Lines are scanned in memory that goes with their number; long texts by parts score as they do whole."""

import resource

import numpy as np
import pyarrow as pa

from rowloom.llm import quality
from rowloom.llm.common import text_chunks

TEXTS = ["Good line here.\nAnother fine one.\n", "bad | bad | bad\n\n", "x", "", "A b c\n" * 7] * 8


def test_one_long_column_of_lines_beside_many_short_texts():
    model = quality.fit(TEXTS, [1, 0, 1, 0, 1] * 8, [1.0] * 40, rounds=5)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    texts = ["\n" * 200_000] + ["ab"] * 20_000
    got = np.concatenate([model.scores(raw, offsets) for _, _, raw, offsets in text_chunks(pa.array(texts), quality.CHUNK)])
    assert len(got) == len(texts) and np.isfinite(got).all() and (got[1:] == got[1]).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # kB


def test_parts_of_a_long_text(monkeypatch):
    model = quality.fit(TEXTS, [1, 0, 1, 0, 1] * 8, [1.0] * 40, rounds=5)
    for text in ("".join(TEXTS) * 40, "no line end at all " * 300, "\n" * 900, "ends so\n" * 100):
        raw = np.frombuffer(text.encode(), np.uint8)
        whole = model.marks(raw, np.array([0, len(raw)]))
        with monkeypatch.context() as m:
            m.setattr(quality, "CHUNK", 100)
            parts = model.marks(raw, np.array([0, len(raw)]))
        assert np.allclose(whole, parts)


def test_scan_against_one_step_after_another():
    rng = np.random.default_rng(3)
    bounds = np.concatenate(([0], np.cumsum(rng.integers(1, 90, 30))))
    e, trans = rng.normal(0, 3, bounds[-1]), rng.normal(0, 1, (2, 2))
    forward, backward = quality.forward_backward(e, bounds, trans)
    (t00, t01), (t10, t11) = trans
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        r, s = e[lo], 0.0
        for t in range(lo, hi):
            r = e[t] + (np.logaddexp(r + t11, t01) - np.logaddexp(r + t10, t00) if t > lo else 0)
            assert np.isclose(forward[t], r)
        for t in range(hi - 1, lo - 1, -1):
            assert np.isclose(backward[t], s)
            s = np.logaddexp(e[t] + s + t11, t10) - np.logaddexp(e[t] + s + t01, t00)
