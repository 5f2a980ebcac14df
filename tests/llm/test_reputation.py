"""The posterior bound against exact sums, registered domains, and hosts that no rule decides but their record does."""

import math

import pytest
from pyspark.sql import functions as F

from rowloom.llm import urlfilter


def below(a, b, x, n=200_000):
    """The share of a beta law below x, by midpoints of its log odds."""
    lo, hi = -40 / min(a, 1) , 40 / min(b, 1)
    step, parts, total = (hi - lo) / n, 0.0, 0.0
    cut = math.log(x / (1 - x))
    top = a * math.log(a / (a + b)) + b * math.log(b / (a + b))
    for i in range(n):
        z = lo + (i + 0.5) * step
        w = math.exp(a * (-max(-z, 0) - math.log1p(math.exp(-abs(z)))) + b * (-max(z, 0) - math.log1p(math.exp(-abs(z)))) - top)
        total += w
        parts += w if z < cut else 0
    return parts / total


def test_quantiles(spark):
    laws = [(1.0, 1.0), (0.2, 3.0), (5.0, 2.0), (40.0, 60.0), (0.5, 0.5)]
    df = spark.createDataFrame(laws, "a double, b double")
    for r in df.withColumn("q", urlfilter.beta_quantile(F.col("a"), F.col("b"), 0.05)).collect():
        assert below(r.a, r.b, r.q) == pytest.approx(0.05, abs=2e-3)
    uniform = df.limit(1).select(urlfilter.beta_quantile(F.col("a"), F.col("b"), 0.05)).first()[0]
    assert uniform == pytest.approx(0.05, abs=1e-3)
    large = spark.createDataFrame([(3e5, 7e5), (900.0, 1e-3)], "a double, b double").select(urlfilter.beta_quantile(F.col("a"), F.col("b"), 0.05).alias("q")).collect()
    assert large[0].q == pytest.approx(0.3 - 1.645 * math.sqrt(0.21 / 1e6), abs=1e-5) and 0.9 < large[1].q <= 1


def test_domains(spark):
    want = {
        "a.b.example.com": ("example.com", "com"), "x.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "example.com:8080": ("example.com", "com"),
        "10.0.0.1": ("10.0.0.1", "address"), "u@h.org": ("h.org", "org"), "localhost": ("localhost", "localhost"), "[::1]:80": ("[::1]", "address"), "": ("", ""), "dot.net.": ("dot.net", "net"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    for r in df.select("host", urlfilter.registered_domain(F.col("host")).alias("d"), urlfilter.host_suffix(F.col("host")).alias("s")).collect():
        assert (r.d, r.s) == want[r.host], r.host


def test_records_separate_hosts_without_rules(spark):
    labelled = [(h, b) for h, bad, n in (("bad.org", 58, 60), ("good.org", 1, 60), ("new.good.org", 0, 2), ("few.info", 2, 2), ("plain.info", 5, 60)) for b in [1] * bad + [0] * (n - bad)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(("bad.org", "sub.bad.org", "good.org", "new.good.org", "few.info", "unseen.info"))], "page_id long, url string")
    out = {r.host: r for r in urlfilter.filter_urls(pages, labelled=spark.createDataFrame(labelled, "host string, bad int")).collect()}
    assert {h for h, r in out.items() if r.verdict == "block"} >= {"bad.org", "sub.bad.org"}
    assert all(out[h].verdict == "allow" for h in ("good.org", "new.good.org", "unseen.info"))
    assert out["sub.bad.org"].rate < out["bad.org"].rate and all(r.bound < r.rate for r in out.values())
