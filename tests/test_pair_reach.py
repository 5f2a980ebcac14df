"""The choice of pairs orders about as many keys as are wanted, not all that there are."""

from pyspark.sql import functions as F

from rowloom.operators import splits


def test_few_keys_are_ordered(spark, monkeypatch):
    keys = spark.range(20_000).select(F.concat(F.lit("p"), F.col("id") % 4).alias("pep"), F.lit("m").alias("mhc"), F.concat(F.lit("g"), "id").alias("grp"))
    quotas = keys.groupBy("pep").agg(F.lit(50).cast("long").alias("quota"))
    ordered, running = [], splits.running

    def counted(df, by, *rest):
        ordered.append(df.count() if by else 0)
        return running(df, by, *rest)

    monkeypatch.setattr(splits, "running", counted)
    chosen = splits.pair_validation(keys, quotas, [keys, keys.where("grp > 'g15'")]).collect()
    assert len(set(chosen)) == 200 and sum(ordered) < 600
    assert all(r.grp > "g15" for r in chosen)  # keys of both peers come first
