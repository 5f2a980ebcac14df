"""Counts, strata and weights of labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def strata(df: DataFrame, by: list[str], sums: dict[str, Column], total: bool = True) -> DataFrame:
    """Sums per stratum, with a total over the last grouping column (null there): grouping sets in one pass."""
    cols = [v.alias(k) for k, v in sums.items()]
    if not total:
        return df.groupBy(*by).agg(*cols)
    return df.groupingSets([[F.col(c) for c in by], [F.col(c) for c in by[:-1]]], *[F.col(c) for c in by]).agg(*cols)


def modal_value(df: DataFrame, key: list[str], value: str, order: str, reject_ties: bool = True) -> DataFrame:
    """(key, value, n, first): the most frequent value of each key; keys whose first two tie are left out, or settled by the value."""
    per = df.groupBy(*key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    w = W.partitionBy(*key)
    out = per.withColumns({"__most": F.max("n").over(w), "__at": F.row_number().over(w.orderBy(F.desc("n"), value))})
    out = out.withColumn("__ties", F.count_if(F.col("n") == F.col("__most")).over(w)).where("__at = 1")
    return (out.where("__ties = 1") if reject_ties else out).select(*key, value, "n", "first")


def major_shares(df: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """(category, n, share): values with `least` rows or more, all others as one."""
    per = df.groupBy(column).count()
    big = per.groupBy(F.when(F.col("count") >= least, F.col(column)).otherwise(other).alias("category")).agg(F.sum("count").alias("n"))
    total = df.agg(F.count("*").alias("t"))
    return big.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("t")).alias("share"))


def with_mean_and_std(df: DataFrame, name: str, measures: list[str], compat: bool = False) -> DataFrame:
    """Rows per fold, then a mean and a std row. compat: the std also counts the mean row, as the reference's tables do."""
    mean = df.agg(*[F.avg(m).alias(m) for m in measures]).select(F.lit("mean").alias(name), *measures)
    base = df.select(F.col(name).cast("string"), *measures)
    of = base.unionByName(mean) if compat else base
    std = of.agg(*[F.stddev_samp(m).alias(m) for m in measures]).select(F.lit("std").alias(name), *measures)
    return base.unionByName(mean).unionByName(std)


def frequency_weights(df: DataFrame, column: str, alpha: float = 0.5) -> DataFrame:
    """(column, n, weight): 1 / (alpha * frequency + (1 - alpha) / K) / K."""
    per = df.groupBy(column).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("__n"), F.count("*").alias("__k"))
    k = F.col("__k")
    return per.join(F.broadcast(total)).select(column, "n", (1 / (alpha * F.col("n") / F.col("__n") + (1 - alpha) / k) / k).alias("weight"))


def weighted_moments(df: DataFrame, vector: str, weight: Column) -> DataFrame:
    """(i, mean, std) of each component with weights; population variance, a std of 1e-3 or less counts as 1."""
    x = df.select(weight.cast("double").alias("w"), F.posexplode(vector).alias("i", "x"))
    m = x.groupBy("i").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("s1"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("s2"))
    mean = F.col("s1") / F.col("w")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("w") - mean * mean))
    return m.select("i", mean.alias("mean"), F.when(std <= 1e-3, 1.0).otherwise(std).alias("std"))


def min_max(df: DataFrame, column: str) -> DataFrame:
    """df with the column as scaled: (x - min) / (max - min); null where they are equal. One row is broadcast."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    return df.join(F.broadcast(ends)).withColumn("scaled", F.try_divide(F.col(column) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def running_best(history: DataFrame, metric: str, epoch: str = "epoch", patience: int = 4) -> DataFrame:
    """history (a row per epoch of a run) with best so far, epochs since, and whether training stops there."""
    w = W.partitionBy("run").orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    out = history.withColumn("best", F.max(metric).over(w))
    out = out.withColumn("best_epoch", F.max(F.when(F.col(metric) > F.coalesce(F.max(metric).over(W.partitionBy("run").orderBy(epoch).rowsBetween(W.unboundedPreceding, -1)), F.lit(float("-inf"))), F.col(epoch))).over(w))
    return out.withColumn("stops", F.col(epoch) - F.col("best_epoch") >= patience)


def masked_scores(df: DataFrame, by: str, predicted: str, actual: str, mask: str) -> DataFrame:
    """(by, pearson, median_ae, median_ape) over unmasked cells; pearson is null where a side doesn't vary."""
    m = df.where(F.col(mask))
    err = F.abs(F.col(predicted) - F.col(actual))
    out = m.groupBy(by).agg(F.try_divide(F.covar_pop(predicted, actual), F.stddev_pop(predicted) * F.stddev_pop(actual)).alias("pearson"), F.median(err).alias("median_ae"), F.median(F.try_divide(err, F.abs(F.col(actual)))).alias("median_ape"))
    return out
