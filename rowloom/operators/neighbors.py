"""Edit-distance joins, nearest neighbours and single-linkage clusters without comparing all pairs.

A string within k edits of another contains one of its k + 1 segments, shifted by k places at most. So segments of one
side, with its length, are keys; substrings of the other side at the allowed shifts and lengths probe them; candidates
meet in an equi-join and are verified by a bounded Levenshtein distance.

Segments of short strings are one to five letters long and tell little. Two strings within k edits also become the same string
when at most k letters are deleted from either, so pairs with a short string meet by hashes of their deletion variants.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.components import connected_components


def _segment(n: Column, i: Column, k: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment i of the k + 1 that a string of length n has, as equal as can be."""
    base, extra = F.floor(n / (k + 1)).cast("int"), (n % (k + 1)).cast("int")
    return (base * i + F.least(i, extra) + 1).cast("int"), (base + (i < extra).cast("int")).cast("int")


def _key(n: Column, i: Column, part: Column) -> Column:
    return F.concat_ws("|", n.cast("string"), i.cast("string"), part)


def _stored(text: Column, k: int) -> Column:
    n = F.length(text)
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: _key(n, i, F.substring(text, *_segment(n, i, k))))


def _probes(text: Column, k: int) -> Column:
    """Keys of all segments that a string within k edits may have kept: each length, each segment, each shift that fits."""
    near = F.sequence(F.lit(-k), F.lit(k))

    def shifted(n: Column, i: Column) -> Column:
        at, size = _segment(n, i, k)
        fits = lambda s: (at + s >= 1) & (at + s + size - 1 <= F.length(text))
        return F.transform(F.filter(near, fits), lambda s: _key(n, i, F.substring(text, at + s, size)))

    by_length = lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: shifted(n, i)))
    lengths = F.filter(F.transform(near, lambda x: F.length(text) + x), lambda n: n >= 0)
    return F.array_distinct(F.flatten(F.transform(lengths, by_length)))


#: Segments of fewer letters than this make poor keys; variants that a string may have before segments are the lesser evil.
LETTERS, VARIANTS = 6, 2048


def short_length(k: int) -> int:
    """Strings up to this length meet by deletion variants: longer ones have segments of LETTERS letters, or too many variants."""
    n = 0
    while n + 1 < LETTERS * (k + 1) and sum(comb(n + 1, i) for i in range(k + 1)) <= VARIANTS:
        n += 1
    return n


def _variants(text: Column, k: int) -> Column:
    """Hashes of all strings that deleting at most k letters leaves."""
    fewer = lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda at: F.concat(F.substring(v, F.lit(1), at - 1), F.substring(v, at + 1, F.length(v))))
    shorter = lambda v: F.when(F.length(v) > 0, fewer(v)).otherwise(F.array().cast("array<string>"))
    last, found = F.array(text), [F.array(text)]
    for _ in range(k):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        found.append(last)
    return F.transform(F.flatten(F.array(*found)), lambda v: F.xxhash64(v))


def candidates(left: DataFrame, right: DataFrame, k: int, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b), repeated: distinct strings of both sides that share a key; every pair within k edits is among them."""
    left, right = (df.select(c).where(F.col(c).isNotNull()).distinct() for df, c in ((left, a), (right, b)))
    most = short_length(k)
    brief = lambda df, c: df.where(F.length(c) <= most + k).select(c, F.explode(_variants(F.col(c), k)).alias("__key"))
    near = brief(left, a).join(brief(right, b), "__key").where((F.least(F.length(a), F.length(b)) <= most) & (F.abs(F.length(a) - F.length(b)) <= k))
    return near.select(a, b).unionByName(edit_pairs_by_segments(left.where(F.length(a) > most), right.where(F.length(b) > most), k, a, b))


def edit_pairs_by_segments(left: DataFrame, right: DataFrame, k: int, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b), repeated: candidates that share a segment."""
    probes = left.select(a, F.explode(_probes(F.col(a), k)).alias("__key"))
    stored = right.select(b, F.explode(F.array_distinct(_stored(F.col(b), k))).alias("__key"))
    return probes.join(stored, "__key").select(a, b)


def edit_pairs(left: DataFrame, right: DataFrame, k: int, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, d) for distinct strings a of left and b of right within k edits."""
    found = candidates(left, right, k, a, b).distinct().withColumn("d", F.levenshtein(F.col(a), F.col(b), k))
    return found.where(F.col("d").between(0, k))


def bounded_self_join(df: DataFrame, text: str, k: int) -> DataFrame:
    """(a, b, d), a < b, for distinct strings within k edits."""
    out = edit_pairs(df.select(F.col(text).alias("a")), df.select(F.col(text).alias("b")), k)
    return out.where("a < b")


def linking_edges(df: DataFrame, text: str, k: int) -> DataFrame:
    """(a, b): verified links that connect all strings within k edits, without all pairs of a dense group.

    Within a key's strings the first is compared with all others; only those that it isn't linked to meet the whole group.
    """
    names = df.select(F.col(text).alias("a")).where(F.col("a").isNotNull()).distinct()
    most = short_length(k)
    linked = lambda x, y: F.levenshtein(x, y, k).between(0, k)
    keyed = names.where(F.length("a") <= most + k).select("a", F.explode(_variants(F.col("a"), k)).alias("__key"))
    first = keyed.groupBy("__key").agg(F.min("a").alias("b"), F.count("*").alias("__n")).where("__n > 1").select("__key", "b")
    met = keyed.join(first, "__key").where("a <> b").withColumn("__ok", linked("a", "b"))
    rest = met.where("NOT __ok").select("__key", "a").join(keyed.select("__key", F.col("a").alias("b")), "__key").where((F.col("a") != F.col("b")) & linked("a", "b"))
    long = names.where(F.length("a") > most)
    far = edit_pairs_by_segments(long, long.withColumnRenamed("a", "b"), k).where((F.col("a") < F.col("b")) & linked("a", "b"))
    return met.where("__ok").select("a", "b").unionByName(rest.select("a", "b")).unionByName(far).distinct()


def nearest_strings(queries: DataFrame, pool: DataFrame, text: str, start: int = 2, most: int = 8) -> DataFrame:
    """(text, min_edit_distance, nearest, nearest_ties) for each distinct query: the lexically first nearest of the pool.

    Rounds of doubling k answer the queries whose nearest string is that near; beyond `most` the few that are left are
    compared with the pool by length, nearest lengths first, until no other length can be nearer.
    """
    todo = queries.select(text).where(F.col(text).isNotNull()).distinct()
    pool = pool.select(F.col(text).alias("__b")).where(F.col("__b").isNotNull()).distinct()
    out, k = None, start
    while k <= most:
        pairs = edit_pairs(todo.withColumnRenamed(text, "__a"), pool, k, "__a", "__b")
        done = _closest(pairs).withColumnRenamed("__a", text).checkpoint()
        out = done if out is None else out.unionByName(done)
        todo = todo.join(done, text, "left_anti").checkpoint()
        if todo.isEmpty():
            return out
        k *= 2
    # strings whose lengths differ by more than the best distance so far can't be nearer
    pool = pool.withColumn("__n", F.length("__b")).checkpoint()
    longest = pool.agg(F.max("__n")).first()[0] or 0
    farthest = max(longest, todo.agg(F.max(F.length(text))).first()[0] or 0)
    todo, before, reach = todo.withColumnRenamed(text, "__a"), -1, most
    best = None
    while not todo.isEmpty():
        away = F.filter(F.sequence(F.length("__a") - reach, F.length("__a") + reach), lambda n: (F.abs(n - F.length("__a")) > before) & n.between(0, longest))
        met = todo.select("__a", F.explode(away).alias("__n")).join(pool, "__n").select("__a", "__b", F.levenshtein("__a", "__b").alias("d"))
        per = met.groupBy("__a", "d").agg(F.min("__b").alias("__b"), F.count("*").alias("n"))
        per = (per if best is None else per.unionByName(best)).groupBy("__a", "d").agg(F.min("__b").alias("__b"), F.sum("n").alias("n"))
        best = per.join(per.groupBy("__a").agg(F.min("d").alias("d")), ["__a", "d"]).checkpoint()
        if reach >= farthest:
            return out.unionByName(_closest(best, "n").withColumnRenamed("__a", text))
        done = best.where(F.col("d") <= reach)  # ties of all lengths are counted too
        out = out.unionByName(_closest(done, "n").withColumnRenamed("__a", text))
        todo = todo.join(done, "__a", "left_anti").checkpoint()
        best = best.join(todo, "__a", "left_semi")
        before, reach = reach, 2 * reach
    return out


def _closest(pairs: DataFrame, counted: str | None = None) -> DataFrame:
    """Counts per (a, d) first, so that a query with many neighbours is summed before it is shuffled."""
    per = pairs.groupBy("__a", "d").agg(F.min("__b").alias("__b"), (F.sum(counted) if counted else F.count("*")).alias("n"))
    best = per.groupBy("__a").agg(F.min(F.struct("d", "__b", "n")).alias("m"))
    return best.select("__a", F.col("m.d").alias("min_edit_distance"), F.col("m.__b").alias("nearest"), F.col("m.n").alias("nearest_ties"))


def single_linkage(df: DataFrame, text: str, k: int) -> DataFrame:
    """(text, cluster): clusters of strings linked within k edits, numbered from 0 by their lexically first member."""
    names = df.select(F.col(text)).where(F.col(text).isNotNull()).distinct()
    labels = connected_components(linking_edges(names, text, k))
    out = names.join(labels, names[text] == labels["node"], "left").select(F.col(text), F.coalesce("label", F.col(text)).alias("__root"))
    # numbers of the clusters: a sort of their roots, then places in a partition after the sizes of those before it
    roots = out.select("__root").distinct().orderBy("__root").select("__root", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")).checkpoint()
    starts, before = [], 0
    for r in sorted(roots.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("least")).collect()):  # a row per partition
        starts.append((r["__p"], before - r.least))
        before += r.n
    starts = df.sparkSession.createDataFrame(starts, "__p int, __shift long")
    numbered = roots.join(F.broadcast(starts), "__p").select("__root", (F.col("__m") + F.col("__shift")).alias("cluster"))
    return out.join(numbered, "__root").select(text, "cluster")
