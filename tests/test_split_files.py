"""Readers that number lines or gather records, over files cut into many splits; masking forms by their rules."""

import pytest
from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.sources import readers


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_row_ids_are_file_order(small_splits, tmp_path):
    lines = [f"row{k}" + "x" * (k % 13) for k in range(400)]
    (tmp_path / "f.csv").write_text("name\n" + "\n".join(lines) + "\n")
    df = readers.read_strings(small_splits, str(tmp_path / "f.csv"), ["name"])
    assert df.rdd.getNumPartitions() > 20
    got = readers.with_row_id(df)
    assert [r.name for r in got.orderBy("row_id").collect()] == lines and got.agg(F.max("row_id")).first()[0] == 399


def test_row_ids_of_several_files_go_by_path(small_splits, tmp_path):
    for name, n in (("b", 90), ("a", 3), ("c", 40)):
        (tmp_path / f"{name}.csv").write_text("name\n" + "\n".join(f"{name}{k:03}" for k in range(n)) + "\n")
    got = [r.name for r in readers.with_row_id(readers.read_strings(small_splits, str(tmp_path), ["name"])).orderBy("row_id").collect()]
    assert got == sorted(got) and len(got) == 133


def test_fasta_records_reach_over_splits(small_splits, tmp_path):
    long = ["ACDE" * 5] * 300
    text = "; a comment\n\n>sp|P1|first > of two\nAC\r\nde\n\n>P2 other\n" + "\n".join(long) + "\n>\n>tr|P3|empty\n>P4\nA C\n  D"
    (tmp_path / "x.fasta").write_text(text)
    (tmp_path / "y.fasta").write_text(">P1\nWW\n")
    got = sorted(map(tuple, readers.read_fasta(small_splits, str(tmp_path)).collect()))
    assert got == sorted([("sp|P1|first > of two", "P1", "ACDE"), ("P2 other", "P2", "".join(long)), ("tr|P3|empty", "P3", ""), ("P4", "P4", "ACD"), ("P1", "P1", "WW")])


def test_matrices_over_splits(small_splits, tmp_path):
    rows = [[(i * 7 + j) % 11 / 2 for j in range(30)] for i in range(50)]
    (tmp_path / "k.csv").write_text("r," + ",".join("A" * 30) + "\n" + "\n".join(f"x{i}," + ",".join(map(str, r)) for i, r in enumerate(rows)))
    got = {(r.i, r.j): r.value for r in readers.read_matrices(small_splits, small_splits.createDataFrame([("k",)], "key string"), str(tmp_path)).collect()}
    assert got == {(i, j): v for i, r in enumerate(rows) for j, v in enumerate(r)}


def test_substitution_matrix_of_any_size(small_splits, tmp_path):
    names = [f"r{k}" for k in range(90)]
    (tmp_path / "m").write_text("# c\n   " + " ".join(names) + "\n" + "\n".join(f"{n} " + " ".join(str(i * j % 5 - 2) for j in range(90)) for i, n in enumerate(names)))
    got = {r.residue: r.scores for r in readers.read_substitution(small_splits, str(tmp_path / "m"), ("r3",)).collect()}
    assert got == {n: [float(i * j % 5 - 2) for j in range(90) if j != 3] for i, n in enumerate(names) if i != 3}
    (tmp_path / "e").write_text("# nothing\n")
    assert readers.read_substitution(small_splits, str(tmp_path / "e")).collect() == []


def test_list_product(spark, tmp_path, monkeypatch):
    (tmp_path / "t").write_text("T1\nT2\n\n")
    (tmp_path / "p").write_text("P1\nP2\nP3\n")
    want = sorted((p, t) for p in ("P1", "P2", "P3") for t in ("T1", "T2"))
    for limit in (1 << 24, 0):
        monkeypatch.setattr(readers, "LIST_BYTES", limit)
        got = readers.read_lists(spark, str(tmp_path / "t"), str(tmp_path / "p"))
        assert got.columns == ["peptide", "tcr"] and sorted(map(tuple, got.collect())) == want


def test_span_masks(spark):
    df = spark.createDataFrame([(n, k, list(range(1, n + 1))) for n in (0, 1, 2, 4, 9, 30) for k in range(200)], "n int, k int, ids array<int>")
    starts = set()
    for r in df.select("n", "k", S.span_masked(F.col("ids"), F.concat_ws("/", "n", "k"), 5, F.lit(0)).alias("m")).collect():
        at = [i for i, t in enumerate(r.m.tokens) if t == 0]
        assert at == list(range(at[0], at[-1] + 1)) if at else r.n < 5
        assert len(at) <= 5 and all(i < 20 for i in at) and (len(at) >= 3 or r.n < 6 or at[-1] == min(r.n, 20) - 1)
        assert [(t or x) for t, x in zip(r.m.tokens, r.m.labels, strict=True)] == list(range(1, r.n + 1)) and all((x == -100) != (i in at) for i, x in enumerate(r.m.labels))
        starts |= {at[0]} if r.n == 30 else set()
    assert len(starts) > 10


def test_three_way_replacement(spark):
    df = spark.range(400).select("id", F.array_repeat(F.lit(7), 60).alias("ids"))
    rows = df.select(S.replaced_tokens(F.col("ids"), F.col("id"), 5, F.lit(-1), 1000).alias("m")).collect()
    pairs = [(t, x) for r in rows for t, x in zip(r.m.tokens, r.m.labels, strict=True)]
    chosen = [t for t, x in pairs if x == 7]
    assert all(t == 7 for t, x in pairs if x == -100) and len(pairs) == 24_000
    assert abs(len(chosen) / 24_000 - 0.15) < 0.01
    share = lambda f: sum(map(f, chosen)) / len(chosen)
    assert abs(share(lambda t: t == -1) - 0.8) < 0.03 and abs(share(lambda t: t == 7) - 0.1) < 0.03 and abs(share(lambda t: t not in (-1, 7)) - 0.1) < 0.03
    none = df.select(S.replaced_tokens(F.col("ids"), F.col("id"), 5, F.lit(-1), 1000, special=F.array(F.lit(7))).alias("m")).first().m
    assert set(none.tokens) == {7} and set(none.labels) == {-100}
