"""Joins and set operations with the checks that they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import sequences as S


def many_to_one(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, whose key must not repeat: a repeated key fails as it is read, without another job."""
    once = right.groupBy(*key).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c not in key])
    once = once.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("right key repeats")).cast("boolean")).otherwise(True)).drop("__n")
    return left.join(once, key, how)


def blocked_pairs(positives: DataFrame, pool: DataFrame, pep: str = "pep", ab: str = "ab") -> DataFrame:
    """Distinct (pep, ab) that no negative may use: the positives, and every donor that shares an endpoint group with one."""
    donors = pool.select(ab).distinct().withColumn("__grp", S.endpoint_group(F.col(ab)))
    groups = positives.select(pep, S.endpoint_group(F.col(ab)).alias("__grp")).distinct()
    return groups.join(donors, "__grp").select(pep, ab).unionByName(positives.select(pep, ab)).distinct()


def overlap(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: distinct keys of a, of b, in both, and that as a share of each. One shuffle of the distinct keys."""
    sides = a.select(*key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    per = sides.groupBy(*key).agg(F.max("__a").alias("a"), F.max("__b").alias("b"))
    out = per.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"))
    return out.select("n_a", "n_b", "n_both", (100 * F.try_divide("n_both", "n_a")).alias("pct_a"), (100 * F.try_divide("n_both", "n_b")).alias("pct_b"))


def in_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def not_in_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def admissible_donors(peptides: DataFrame, pool: DataFrame, blocked: DataFrame, pep: str = "pep", ab: str = "ab") -> DataFrame:
    """(pep, n_admissible): how many donors of the pool each peptide may use, without pairing peptides and pool: the pool's
    size less the distinct blocked donors of the peptide that are in the pool."""
    donors = pool.select(ab).distinct()
    size = donors.agg(F.count("*").alias("__size"))
    used = blocked.select(pep, ab).distinct().join(donors, ab, "left_semi").groupBy(pep).agg(F.count("*").alias("__used"))
    out = peptides.select(pep).distinct().join(used, pep, "left").join(F.broadcast(size))
    return out.select(pep, (F.col("__size") - F.coalesce("__used", F.lit(0))).alias("n_admissible"))


def lookup(df: DataFrame, table: DataFrame, key: str, values: list[str]) -> DataFrame:
    return df.join(table.select(key, *values), key, "left")


def resolve(df: DataFrame, exact: DataFrame, fallback: DataFrame, exact_key: Column, fallback_key: Column, name: str = "sequence") -> DataFrame:
    """df with `name` and how: by the exact key, else by the fallback key, else null. Tables have (key, value)."""
    keyed = df.withColumns({"__k1": exact_key, "__k2": fallback_key})
    keyed = keyed.join(exact.select(F.col("key").alias("__k1"), F.col("value").alias("__v1")), "__k1", "left")
    keyed = keyed.join(fallback.select(F.col("key").alias("__k2"), F.col("value").alias("__v2")), "__k2", "left")
    how = F.when(F.col("__v1").isNotNull(), "exact").when(F.col("__v2").isNotNull(), "fallback")
    return keyed.select(*df.columns, F.coalesce("__v1", "__v2").alias(name), how.alias("resolution"))


def mismatches(a: DataFrame, b: DataFrame, columns: list[str], order: str = "row_id") -> DataFrame:
    """One row: rows that differ in any column, and rows only in one table. All 0 means the tables correspond."""
    x, y = a.select(order, F.struct(*columns).alias("x")), b.select(order, F.struct(*columns).alias("y"))
    both = x.join(y, order, "full")
    return both.agg(
        F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != F.col("y"))).alias("differ"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched")
    )


def rejoin_results(inputs: DataFrame, results: DataFrame, values: list[str], order: str = "row_id") -> DataFrame:
    """inputs with the results of a worker, in input order; repeated or missing result rows fail as they are read."""
    out = many_to_one(inputs, results.select(order, *values, F.lit(True).alias("__had")), [order], "left")
    return out.where(F.when(F.col("__had"), True).otherwise(F.raise_error(F.lit("result row missing")).cast("boolean"))).drop("__had").orderBy(order)


def key_overlaps(splits: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """(a, b, shared): distinct keys that two splits share, for each pair of splits; all 0 means no leakage. One shuffle."""
    names = sorted(splits)
    tagged = None
    for i, n in enumerate(names):
        part = splits[n].select(*key, F.lit(1 << i).alias("__bit"))  # bits are or'ed before the shuffle, so no distinct of each split
        tagged = part if tagged is None else tagged.unionByName(part)
    per = tagged.groupBy(*key).agg(F.bit_or("__bit").alias("bits"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    sums = per.agg(*[F.count_if(F.col("bits").bitwiseAND((1 << i) | (1 << j)) == (1 << i) | (1 << j)).alias(f"{names[i]}|{names[j]}") for i, j in pairs])
    out = sums.unpivot([], [f"{names[i]}|{names[j]}" for i, j in pairs], "pair", "shared")
    return out.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "shared")


def same_sets(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: keys only in a, only in b."""
    x = a.select(*key).distinct().withColumn("__a", F.lit(1))
    y = b.select(*key).distinct().withColumn("__b", F.lit(1))
    both = x.join(y, key, "full")
    return both.agg(F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b"))


def unobserved_counts(every: DataFrame, observed: DataFrame, left: str, right: str) -> DataFrame:
    """(left, n): for each left of `every` how many of its distinct rights it has no row of `observed` with; lefts without any have no
    row. Counts tell: no product of lefts and rights is made. Nulls are no values."""
    rights = every.select(right).where(F.col(right).isNotNull()).distinct()
    lefts = every.select(left).where(F.col(left).isNotNull()).distinct()
    met = observed.select(left, right).distinct().join(rights, right, "left_semi").groupBy(left).agg(F.count("*").alias("__met"))
    n = F.lit(rights.count()) - F.coalesce("__met", F.lit(0))
    return lefts.join(met, left, "left").select(left, n.alias("n")).where("n > 0")
