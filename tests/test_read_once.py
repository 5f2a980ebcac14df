"""Plans that go over their input once, however many steps follow."""

from pyspark.sql import functions as F

from rowloom.operators import negatives
from rowloom.plans.prepare import Config, prepare
from rowloom.schema import Caps


def _counted(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(x):
        seen.add(1)
        return x

    return seen, same


def test_corpus_is_read_once(spark):
    seen, same = _counted(spark)
    base = spark.range(60).select(F.concat(F.lit("ACDEFGHI"), F.element_at(F.array(*map(F.lit, "KLMN")), (F.col("id") % 4 + 1).cast("int"))).alias("pep"), F.lit("S1").alias("hla"), F.lit("S1").alias("hla_allele"), F.concat(F.lit("CA"), F.translate("id", "0123456789", "ACDEGHIKLM"), F.lit("F/CSF")).alias("ab"), F.lit(1).alias("label"))
    made = prepare({"x": base.withColumn("pep", same("pep"))}, base.limit(2), Config("x", caps=Caps(1, 40, 2, 40)))["x"]
    assert made["report"]["train"] + made["valid"].where("label = 1").count() + 2 == 60 and made["report"]["excluded"] == 0
    assert seen.value == 60


def test_other_targets_read_rows_once(spark):
    seen, same = _counted(spark)
    rows = spark.createDataFrame([("t1", "a1", "b1"), ("t1", "a2", "b2"), ("t2", "a1", "b3"), ("t3", "a4", "b4")], "t string, a string, b string")
    got = {r.t: r.n for r in negatives.other_targets(rows.withColumn("a", same("a")), "t").collect()}
    assert got == {"t1": 1, "t2": 2, "t3": 3} and seen.value == 4


def test_numbered_pool_has_more_tasks_for_more_rows(spark, monkeypatch):
    """One task gets at most about POOL_PART rows."""
    pool = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("ab"))
    want = sorted(map(tuple, negatives.numbered_pool(pool).collect()))
    assert [r[0] for r in want] == list(range(4000))
    monkeypatch.setattr(negatives, "POOL_PART", 100)
    parts, repartition = [], type(pool).repartition
    monkeypatch.setattr(type(pool), "repartition", lambda df, n, *by: parts.append(n) or repartition(df, n, *by))
    assert sorted(map(tuple, negatives.numbered_pool(pool).collect())) == want and parts == [40]


def test_row_ids_without_ordering_rows(spark, tmp_path, monkeypatch):
    """Only a row per split is ordered; a path given twice is numbered too."""
    from rowloom.sources import readers

    path = str(tmp_path / "rows")
    spark.range(500).select(F.col("id").cast("string")).repartition(3).write.csv(path)
    ordered, running = [], readers.running
    monkeypatch.setattr(readers, "running", lambda df, *rest: ordered.append(df.count()) or running(df, *rest))
    read = lambda *paths: spark.read.schema("x string").csv(list(paths))
    assert sorted(r.row_id for r in readers.with_row_id(read(path)).collect()) == list(range(500)) and ordered == [3]
    assert sorted(r.row_id for r in readers.with_row_id(read(path, path)).collect()) == list(range(1000))
