"""Train, validation and test splits that leak nothing: by pair, by group, by frequency, by fold."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.operators.components import checkpoint_dir, stored
from rowloom.operators.joins import not_in_keys
from rowloom.operators.ranks import repeated, running

_KEY = ["pep", "mhc", "grp"]
GROUPINGS = ("pair_stratified", "peptide", "cluster")
#: Frequency bins: (name, largest count).
BINS = (("1", 1), ("2", 2), ("3-5", 5), ("6-10", 10), ("11-25", 25), (">25", None))


def keyed(df: DataFrame, pep: str = "pep", mhc: str = "hla_allele", ab: str = "ab") -> DataFrame:
    """Distinct keys (pep, mhc, grp)."""
    return df.select(S.norm(F.col(pep)).alias("pep"), S.norm(F.col(mhc)).alias("mhc"), S.endpoint_group(F.col(ab)).alias("grp")).distinct()


def pair_quotas(keys: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """(pep, n, quota): validation pairs per peptide with more than one pair, at most n - 1 each.

    The request is ceil(all pairs * fraction), at least 1 and at most the total capacity. Base quotas are floors of the
    proportional share; what is left fills peptides to capacity by falling fractional part, then tie, then name: running
    sums of capacity in that order, part by part.
    """
    per = stored(keys.groupBy("pep").agg(F.count("*").alias("n")))
    total = per.agg(F.sum("n").alias("__total"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("cap"))
    wanted = F.least(F.greatest(F.lit(1), F.ceil(F.col("__total") * F.lit(float(fraction)))), F.col("cap"))
    open_ = per.where("n > 1").join(F.broadcast(total.select("__total", wanted.alias("wanted"))))
    share = F.col("wanted") * F.col("n") / F.col("__total")
    base = F.least(F.floor(share), F.col("n") - 1)
    open_ = open_.withColumns({"base": base, "frac": share - F.floor(share), "tie": S.hash_order(seed, F.col("pep"))})
    left = open_.agg(F.first("wanted").alias("w"), F.sum("base").alias("b")).select((F.col("w") - F.col("b")).alias("left"))
    spare = F.col("n") - 1 - F.col("base")
    open_ = running(open_, [], [F.desc("frac"), F.desc("tie"), F.desc("pep")], {"before": spare})
    more = F.greatest(F.lit(0), F.least(spare, F.col("left") - F.col("before")))
    return open_.join(F.broadcast(left)).select("pep", "n", (F.col("base") + more).cast("long").alias("quota"))


def pair_validation(keys: DataFrame, quotas: DataFrame, peers: list[DataFrame], seed: int = 42) -> DataFrame:
    """Chosen keys: within a peptide those that most peers share come first, then by hash; a peer never loses its last pair
    of the peptide. Keys that no peer has are never chosen."""
    tagged = keys.select(*_KEY, F.lit(-1).alias("__peer"))
    for i, p in enumerate(peers):
        tagged = tagged.unionByName(p.select(*_KEY, F.lit(i).alias("__peer")))
    has = [f"__has{i}" for i in range(len(peers))]
    among = [F.max((F.col("__peer") == i).cast("int")).alias(c) for i, c in zip((-1, *range(len(peers))), ("__in", *has), strict=True)]
    return chosen_pairs(stored(tagged.groupBy(*_KEY).agg(*among)), quotas, has, seed)


def chosen_pairs(rows: DataFrame, quotas: DataFrame, has: list[str], seed: int = 42) -> DataFrame:
    """pair_validation of rows, one for each key: columns `has` are 1 where the peer has the key, else 0; __in, where given, is 1 if
    the key may be chosen.

    Keys are gone through in order for all peptides at once. Until a peer of a peptide comes to its last pair, which keys
    are taken depends on which peers they are in alone, so running sums tell how far that is; the next round goes on behind it
    without that peer's keys. Rounds are one more than peers at most, and no task holds a peptide. Counts per peers and leading
    digits of the hash tell how far the quota can reach, so only about as many keys as are wanted are ordered. rows should be
    stored: they are read twice a round. What is joined to them by peptide is stored, so that Spark broadcasts it where it is small.
    """
    most, tie = sum((F.col(c) for c in has), F.lit(0)), S.hash_order(seed, *[F.col(k) for k in _KEY])
    left, sums = ([f"__{kind}{i}" for i in range(len(has))] for kind in ("left", "sum"))
    state = rows.groupBy("pep").agg(*[F.sum(F.col(h).cast("long")).alias(n) for h, n in zip(has, left, strict=True)])
    place = F.struct((-most).cast("int").alias("less"), tie.alias("tie"), F.col("mhc"), F.col("grp"))
    rows = rows.where((most > 0) & F.col("mhc").isNotNull() & F.col("grp").isNotNull())
    rows = rows.where("__in = 1") if "__in" in rows.columns else rows
    nowhere = F.lit(None).cast(rows.select(place.alias("p")).schema["p"].dataType)
    state = stored(state.join(quotas.where("quota > 0").select("pep", F.col("quota").alias("__want")), "pep").withColumn("__after", nowhere))
    out = None
    for _ in range(len(has) + 1):
        live = rows.join(state, "pep").where(F.col("__after").isNull() | (place > F.col("__after")))
        for h, n in zip(has, left, strict=True):
            live = live.where((F.col(h) == 0) | (F.col(n) > 1))
        coarse = F.struct((-most).cast("int").alias("less"), F.substring(tie, 1, 3).alias("digits"))
        per = live.groupBy("pep", coarse.alias("__at")).agg(F.count("*").alias("__n"), F.first("__want").alias("__want"))  # at most 16 ** 3 rows a peptide and number of peers
        before = F.coalesce(F.sum("__n").over(W.partitionBy("pep").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        reach = stored(per.withColumn("__before", before).where("__before < __want").groupBy("pep").agg(F.max("__at").alias("__reach")))
        live = stored(live.join(reach, "pep").where(coarse <= F.col("__reach")).select(*_KEY, *has, *left, "__want", place.alias("__place")))
        live = running(live, ["pep"], ["__place"], {"__taken": F.lit(1), **{x: F.col(h) for x, h in zip(sums, has, strict=True)}})
        ends = F.col("__taken") + 1 == F.col("__want")
        for h, n, x in zip(has, left, sums, strict=True):
            ends = ends | ((F.col(h) == 1) & (F.col(n) - F.col(x) == 2))
        live = stored(live.withColumn("__ends", ends))
        cuts = live.where("__ends").groupBy("pep").agg(F.min("__taken").alias("__cut"))
        taken = stored(live.join(cuts, "pep", "left").where(F.col("__cut").isNull() | (F.col("__taken") <= F.col("__cut"))))
        out = taken.select(*_KEY) if out is None else out.unionByName(taken.select(*_KEY))
        used = taken.where("__cut IS NOT NULL").groupBy("pep").agg(F.max("__place").alias("__after"), F.count("*").alias("__used"), *[F.sum(h).alias(x) for h, x in zip(has, sums, strict=True)])
        state = state.drop("__after").join(used, "pep").select("pep", (F.col("__want") - F.col("__used")).alias("__want"), "__after", *[(F.col(n) - F.col(x)).alias(n) for n, x in zip(left, sums, strict=True)])
        state = stored(state.where("__want > 0"))
        if state.isEmpty():
            break
    return out


#: Rows left open for the exact choice of groups, at first and at most: its memory, whatever the table holds.
FIRST_ROOM, MOST_ROOM = 1 << 12, 1 << 22


def nearest_counts(sizes: list[tuple[int, int]], target: int, limit: int, empty: bool, seed: int = 42) -> dict[int, int]:
    """{size: groups} whose rows sum nearest to target, of equally near sums the smaller one, at most `limit` rows in all.

    sizes has (size, how many groups have it). Groups of one size are alike, so counts are halved into items of 1, 2, 4, ... of
    them, and of each sum it is noted which item reached it first. It ends as soon as target is reached. Without `empty` the
    answer has a group, if any fits.
    """
    sizes = sorted(sizes)
    least = sizes[0][0] if sizes else limit + 1
    if least > limit:
        return {}
    top = min(limit, max(2 * target, least))  # what overshoots by more than target is farther than nothing
    items = []
    for i in np.random.default_rng(seed).permutation(len(sizes)):
        n, left = sizes[i]
        left, step = min(left, top // n), 1
        while left > 0:
            items.append((n, min(step, left)))
            left, step = left - step, 2 * step
    first, reached = np.full(top + 1, -1, np.int32), np.zeros(top + 1, bool)
    reached[0] = True
    for k, (n, times) in enumerate(items):
        n *= times
        if n <= top:
            new = np.flatnonzero(reached[: top + 1 - n] & ~reached[n:]) + n
            first[new], reached[new] = k, True
        if target <= top and reached[target]:
            break
    sums = np.flatnonzero(reached)
    sums = sums if empty else sums[1:]
    left, chosen = int(sums[np.argmin(np.abs(sums - target))]), {}
    while left:
        n, times = items[first[left]]
        chosen[n] = chosen.get(n, 0) + times
        left -= n * times
    return chosen


def _first_groups(sizes: DataFrame, group: str, wanted: int, slack: int) -> tuple[DataFrame, DataFrame, int]:
    """(taken, rest, rows taken): groups in hash order while they fit into wanted rows. Those that don't are passed over, until
    at most slack rows are open or no group fits."""
    taken, rest, left = sizes.limit(0), sizes, wanted
    while left > slack:
        fits = running(rest.where(F.col("__n") <= left), [], ["__h", group], {"__before": F.col("__n")}).checkpoint()
        more = fits.where(F.col("__before") + F.col("__n") <= left).drop("__before")
        used = more.agg(F.sum("__n")).first()[0]
        if not used:
            break
        taken, rest, left = taken.unionByName(more), rest.join(more.select(group), group, "left_anti").checkpoint(), left - used
    return taken, rest, max(wanted, 0) - max(left, 0)


def group_validation(df: DataFrame, group: str, fraction: float, seed: int = 42) -> DataFrame:
    """(group) chosen for validation: groups whose rows sum nearest to ceil(rows * fraction), at least one group and never all.

    Groups come in hash order until few rows are open; what is open is filled exactly by counts per size, so that the driver
    sees a row per distinct size of a group, never the groups. While that doesn't give the very number, more is left open, up to
    MOST_ROOM rows. The result is therefore the very number, or the nearest one of all where the target is within MOST_ROOM, or
    else the nearest one to be had with the groups of the first part. Rows without a group take no part; fewer than two groups
    give none.
    """
    checkpoint_dir(df.sparkSession)
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("__n")).withColumn("__h", S.hash_order(seed, F.col(group))).checkpoint()
    total, groups = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count("*")).first()
    if groups < 2:
        return sizes.select(group).limit(0)
    target, room, best = max(1, math.ceil(total * fraction)), FIRST_ROOM, None
    while True:
        taken, rest, used = _first_groups(sizes, group, target - room, room)
        left, limit = target - used, total - 1 - used
        per = rest.groupBy("__n").agg(F.count("*").alias("k"))
        if left <= 3 * room:
            near = per.where(F.col("__n") <= 2 * left)
            more = nearest_counts(_with_least(near, per), left, limit, used > 0, seed)
        else:  # every group left has over two thirds of what is open: one of them or none
            ends = per.agg(F.max(F.when(F.col("__n") <= left, F.col("__n"))), F.min(F.when(F.col("__n") > left, F.col("__n")))).first()
            one = min((n for n in (*ends, 0 if used else None) if n is not None and n <= limit), key=lambda n: (abs(n - left), n), default=0)
            more = {one: 1} if one else {}
        off = abs(left - sum(n * k for n, k in more.items()))
        if best is None or off < best[0]:
            best = off, taken, rest, more
        if not off or room >= min(target, MOST_ROOM):
            break
        room *= 32
    _, taken, rest, more = best
    counts = df.sparkSession.createDataFrame(list(more.items()), "__n long, __k long")
    ranked = running(rest.join(F.broadcast(counts), "__n"), ["__n"], ["__h", group], {"__before": F.lit(1)})  # a row per chosen size
    return stored(taken.select(group).unionByName(ranked.where("__before < __k").select(group)))


def _with_least(near: DataFrame, per: DataFrame) -> list[tuple[int, int]]:
    """Rows of near, or the smallest size of all if there is none."""
    return [tuple(r) for r in near.collect()] or [tuple(r) for r in per.orderBy("__n").limit(1).collect()]


def apply_validation(df: DataFrame, validation: DataFrame, grouping: str, clusters: DataFrame | None = None) -> DataFrame:
    """df without what validation holds: pairs (pep, mhc, grp), peptides, or clusters of peptides."""
    if grouping not in GROUPINGS:
        raise ValueError(f"unknown grouping: {grouping}")
    if grouping == "pair_stratified":
        return not_in_keys(df, validation, ["pep", "mhc", "grp"])
    if grouping == "peptide":
        return not_in_keys(df, validation, ["pep"])
    held = validation.select("pep").distinct().join(clusters, "pep").select("cluster").distinct()
    return df.join(clusters, "pep", "left").join(held, "cluster", "left_anti").drop("cluster")


def frequency_bin(count: Column) -> Column:
    out = F.lit(BINS[-1][0])
    for name, top in reversed(BINS[:-1]):
        out = F.when(count <= top, name).otherwise(out)
    return out


def frequency_allocation(counts: DataFrame, evaluate: int, seed: int = 42, key: str = "pep", n: str = "n") -> DataFrame:
    """(key, n, bin, split): `evaluate` keys each to test and valid, spread over frequency bins by largest remainder, the rest
    to train. Within a bin the order is that of a hash, test first. Ties of remainders go to the earlier bin."""
    binned = counts.select(key, n, frequency_bin(F.col(n)).alias("bin"))
    sizes = {r.bin: r["count"] for r in binned.groupBy("bin").count().collect()}  # one row per bin
    quota = largest_remainder([sizes.get(b, 0) for b, _ in BINS], evaluate)
    take = F.lit(0)
    for (b, _), q in zip(BINS, quota, strict=True):
        take = F.when(F.col("bin") == b, q).otherwise(take)
    order = binned.withColumn("__hash", S.hash_order(seed, F.col(key)))
    ranked = running(order, ["bin"], ["__hash", key], {"__before": F.lit(1)})
    split = F.when(F.col("__before") < take, "test").when(F.col("__before") < 2 * take, "valid").otherwise("train")
    return ranked.select(key, n, "bin", split.alias("split"))


def largest_remainder(sizes: list[int], wanted: int) -> list[int]:
    """wanted shared out in proportion to sizes: floors, then one more each by falling remainder."""
    total = sum(sizes)
    if not total or 2 * wanted > total:
        raise ValueError(f"cannot take 2 * {wanted} of {total}")
    floors = [wanted * s // total for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (-(wanted * sizes[i] % total), i))
    for i in order[: wanted - sum(floors)]:
        floors[i] += 1
    return floors


def tail_sample(counts: DataFrame, share: float = 0.8, take: int = 100, seed: int = 42, key: str = "pep", n: str = "n") -> DataFrame:
    """(key, n): `take` keys by hash among the rarest floor(share * keys) ones, by count then name. The border of the tail
    comes from counts per frequency; only keys of the border's frequency are ranked."""
    total = counts.count()
    want = math.floor(total * share)
    per = sorted((r[0], r[1]) for r in counts.groupBy(n).count().collect())  # one row per frequency
    below, border, room = 0, None, 0
    for value, size in per:
        if below + size >= want:
            border, room = value, want - below
            break
        below += size
    edge = counts.where(F.col(n) == border).orderBy(key).limit(room)
    tail = counts.where(F.col(n) < border).unionByName(edge) if border is not None else counts.limit(0)
    return tail.orderBy(S.hash_order(seed, F.col(key)), key).limit(take)


#: Rows of one round of permutations.
ROUND = 1 << 22


def rejection_partition(counts: DataFrame, evaluate: int, cap: int, tolerance: float = 0.05, seed: int = 42, attempts: int = 100_000, key: str = "pep") -> DataFrame:
    """(key, split, attempt): whole permutations of (key, rows, unique) until the first two blocks of `evaluate` keys, valid and
    test, have at most cap rows each and differ by at most `tolerance` in rows and in unique pairs.

    A permutation is the order of a hash of attempt and key. Rounds try one, two, four, ... of them side by side, as many as
    ROUND rows hold; the first that fits counts, so rounds don't show in the result. Keys are ranked by running sums and
    never gathered.
    """
    checkpoint_dir(counts.sparkSession)
    counts = counts.select(key, "rows", "unique").checkpoint()
    n = counts.count()
    if 2 * evaluate > n:
        raise ValueError(f"cannot take 2 * {evaluate} of {n}")
    at, width = 1, 1
    while at <= attempts:
        width = min(width, attempts - at + 1)
        tried = counts.withColumn("attempt", F.explode(F.sequence(F.lit(at), F.lit(at + width - 1))))
        tried = tried.withColumn("__h", S.hash_order(seed, F.col("attempt"), F.col(key)))
        placed = running(tried, ["attempt"], ["__h", key], {"__place": F.lit(1)}).where(F.col("__place") < 2 * evaluate).checkpoint()
        first = F.col("__place") < evaluate
        sums = placed.groupBy("attempt").agg(*[F.sum(F.when(side, F.col(c)).otherwise(0)).alias(f"{c}_{i}") for c in ("rows", "unique") for i, side in enumerate((first, ~first))])
        fits = F.greatest("rows_0", "rows_1") <= cap
        for c in ("rows", "unique"):
            a, b = F.col(f"{c}_0"), F.col(f"{c}_1")
            fits = fits & (F.abs(a - b) <= tolerance * F.greatest(a, b))
        found = sums.where(fits).agg(F.min("attempt")).first()[0]
        if found is not None:
            return placed.where(F.col("attempt") == found).select(key, F.when(first, "valid").otherwise("test").alias("split"), "attempt")
        at, width = at + width, max(1, min(2 * width, ROUND // max(n, 1)))
    raise ValueError("no permutation fits")


def hash_folds(df: DataFrame, folds: int, seed: int = 42, key: str = "pep") -> DataFrame:
    """(key, fold) of distinct keys in hash order: round(n / folds) keys each, so some may be left over (fold null).

    Ranks come from counts per leading hash digits and ranks within them: no task orders all keys.
    """
    keys = df.select(key).distinct().withColumn("__h", S.hash_order(seed, F.col(key)))
    keys = keys.withColumn("__p", F.substring("__h", 1, 3))
    sizes = sorted((r[0], r[1]) for r in keys.groupBy("__p").count().collect())  # at most 16 ** 3 rows
    total, before, starts = sum(s for _, s in sizes), 0, []
    for p, s in sizes:
        starts.append((p, before))
        before += s
    each = round(total / folds) if total else 1
    first = df.sparkSession.createDataFrame(starts, "__p string, __before long")
    rank = F.row_number().over(W.partitionBy("__p").orderBy("__h", key)) - 1 + F.col("__before")
    fold = F.floor(rank / max(1, each))
    return keys.join(F.broadcast(first), "__p").select(key, F.when(fold < folds, fold).cast("int").alias("fold"))


def fold_shares(load: list[int], n: int, count: int) -> list[int]:
    """How many of `count` groups of n rows each fold gets, if each goes to the lightest fold, the earlier one of equals.

    Fold f takes its i-th at a load of load[f] + i n; the count smallest of these (load, fold) are taken. The level below
    which all are taken is found by bisection, so no group is gone through.
    """
    below = lambda level: [max(0, -(-(level - x) // n)) for x in load]
    low, high = min(load), max(load) + n * (count + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    out = below(low)
    for f, x in enumerate(load):
        if sum(out) < count and x + out[f] * n == low:
            out[f] += 1
    return out


def group_folds(sizes: DataFrame, folds: int, group: str = "brand", n: str = "n") -> DataFrame:
    """(group, fold): each group to the lightest fold, the largest first, then by name; of equally light folds the first.

    Groups of one size are alike but for their names, so the driver goes through distinct sizes only (their square is at most
    twice the rows) and notes what each fold gets; Spark makes a slot for each of these, ranks slots by load and groups by name,
    and joins the ranks. Null is a group.
    """
    spark = sizes.sparkSession
    checkpoint_dir(spark)
    sizes = sizes.select(group, F.col(n).cast("long").alias("__n")).checkpoint()
    load, rows = [0] * folds, []
    for size, count in sorted((tuple(r) for r in sizes.groupBy("__n").count().collect()), reverse=True):
        share = fold_shares(load, size, count)
        rows += [(size, f, load[f], k) for f, k in enumerate(share) if k]
        load = [x + k * size for x, k in zip(load, share, strict=True)]
    shares = spark.createDataFrame(rows, "__n long, fold int, __load long, __k long")
    slots = repeated(shares, F.lit(0).cast("long"), F.col("__k"), "__i").withColumn("__at", F.col("__load") + F.col("__i") * F.col("__n"))
    slots = running(slots.select("__n", "fold", "__at"), ["__n"], ["__at", "fold"], {"__place": F.lit(1)})
    named = running(sizes, ["__n"], [group], {"__place": F.lit(1)})
    return named.join(slots, ["__n", "__place"]).select(group, "fold")


def ratio_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """df with split: valid where the key's hash falls below share, else train."""
    return df.withColumn("split", F.when(S.hash_uniform(F.lit(str(seed)), F.col(key)) < share, "valid").otherwise("train"))
