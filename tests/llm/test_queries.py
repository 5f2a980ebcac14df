"""The registered queries: columns, agreement with SQL, reruns, and the pipeline stage by stage."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

NAMES = sorted(n for n in entry.queries() if n.startswith("op"))


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("number", [3, 11])
def test_agrees_with_sql(spark, sf, number):
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    name = next(n for n in NAMES if n.startswith(f"op{number}_"))
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r)) for r in entry.queries()[name](spark, sf).select(*columns).collect()) == want


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("op3_")])
def test_one_row_per_document(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if "doc_id" in df.columns and "piece" not in df.columns:
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert rows


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    assert docs.agg({"n_words": "sum"}).first()[0] > 0 and os.path.isdir(tmp_path)


# --- each contract's fixed columns, as the query returns them, against plain Python ------------------------------------
WORD = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def result(spark, sf, n):
    name = next(x for x in NAMES if x.startswith(f"op{n}_"))
    return entry.queries()[name](spark, sf).collect()


@pytest.mark.parametrize("n, mod, rest", [(1, 3, 1), (5, 4, 2), (10, 7, 2)])
def test_held_out(spark, sf, texts, n, mod, rest):
    for r in result(spark, sf, n):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest)
        if n == 1:
            known = {x.lang for x in texts.values()} - {None}
            assert r.lang_pred in known | {"und"} and 0 <= r.score <= 1
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id].text or ""))
        if n == 5:
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_op2_sizes_and_targets(spark, sf, texts):
    sizes = {k: len(WORD.findall(r.text or "")) for k, r in texts.items()}
    by = {}
    for k, r in texts.items():
        by[r.source] = by.get(r.source, 0) + sizes[k]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, todo = {}, 1.5 * sum(by.values()), list(names)
    while todo:
        unit = left / sum(weight[s] for s in todo)
        over = [s for s in todo if unit * weight[s] >= 2 * by[s]]
        for s in over or todo:
            target[s] = 2 * by[s] if over else unit * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        todo = [s for s in todo if s not in over]
    taken = dict.fromkeys(names, 0)
    for r in result(spark, sf, 2):
        source = texts[r.doc_id].source
        assert (r.size, r.source_size) == (sizes[r.doc_id], by[source]) and r.target == pytest.approx(target[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_op4_edits(spark, sf, texts):
    order = sorted(texts, reverse=True)
    after = {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    rows = {r.doc_id: r for r in result(spark, sf, 4)}
    for k, r in rows.items():
        t, u = texts[k].text or "", texts[after[k]].text or ""
        half = len(t) // 2
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for j, x in rows.items():
            if (texts[j].text or "") == t:
                assert x.fingerprint == r.fingerprint


def test_op7_fingerprints_and_components(spark, sf, texts):
    prints = {}
    for k, r in texts.items():
        words = WORD.findall(low(r.text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    for r in result(spark, sf, 7):
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == root[r.doc_id]


def test_op8_base_spans(spark, sf, texts):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in result(spark, sf, 8):
        t, spans = texts[r.doc_id].text or "", []
        spans += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        counts = [sum(s[1] == k for s in spans) for k in range(3)]
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        joined = [s[2] for s in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r.spans.split(","))


def test_op9_nearest(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in rows if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)}
    want = []
    for q in x:
        if q % 50 == 0:
            best = sorted((-float(x[q] @ x[k] / np.sqrt((x[q] @ x[q]) * (x[k] @ x[k]))), k) for k in x if k != q)[:5]
            want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    got = sorted(tuple(r)[:4] for r in result(spark, sf, 9))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=1e-12)


def test_op3_of_awkward_pages(spark, tmp_path):
    rows = [(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://b.net/es/1"), (2, None), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/?q"), (5, "x://example.com/en/a#b"), (6, "://"), (7, "")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    name = next(n for n in NAMES if n.startswith("op3_"))
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert sorted((r.host, r.path, r.rule) for r in got if r.page_id in (4, 5)) == [("example.com", "/en/a", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/")]
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert entry.queries()[name](spark, f"{tmp_path}/none").count() == 0


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a " * 9000, None, None, 18000), (None, "\u00bd \u00e9", "fr", "s", 3), (3, "q" * 70_000, "en", "t", 70_000)]])
def test_pipeline_and_queries_of_awkward_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a a a"), (2, None)] if rows else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
    for name in NAMES:
        if not name.startswith(("op3_", "op6_", "op9_", "op13_")):
            assert entry.queries()[name](spark, str(tmp_path)).count() == len(rows), name


def test_pipeline_keeps_other_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(i) for i, c in enumerate(("__row", "__kept", "id", "row", "size", "shard", "fp", "idx", "block", "n", "words", "__text"))})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {out.first()["row"], out.first()["block"]} == {3, 8}, name
