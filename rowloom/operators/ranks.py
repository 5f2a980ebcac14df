"""Running sums over groups of any size, keyed permutations, and places that are open once blocked ones are taken out.

No window of running() runs over a whole group: rows are dealt by range of (group, order), summed within their part, and shifted by the
sums of the group's earlier parts, of which there is a row per part at most. Places of draws come by groups cut into blocks; a target with
few segments is one block, with all its draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.operators.components import checkpoint_dir, stored

#: Steps after which a walk back into [0, n) is an error; only above n = STEPS^2 can it need more, with odds under 2^-300.
STEPS = 64
#: Segments of one target beyond which it is gone through in blocks.
BLOCK = 1 << 16


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: its sum over the rows of the same `by` that come before in `order`, 0 for the first.

    order has to tell rows apart (rows that it doesn't come in any order). Null keys are a group. Rows are stored once in the
    checkpoint folder between the two passes, so both see the same parts.
    """
    checkpoint_dir(df.sparkSession)
    order = [F.asc(o) if isinstance(o, str) else o for o in order]
    value, inner, shift = ({n: f"__{kind}_{n}" for n in sums} for kind in ("value", "inner", "shift"))
    dealt = df.withColumns({value[n]: c for n, c in sums.items()}).repartitionByRange(*[F.asc(c) for c in by], *order)
    dealt = dealt.withColumn("__part", F.spark_partition_id()).checkpoint()
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    first = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("__part", *by).agg(*[F.sum(value[n]).alias(value[n]) for n in sums])
    shifts = totals.select("__part", *by, *[before(value[n], first).alias(shift[n]) for n in sums], F.lag("__part").over(W.partitionBy(*by).orderBy("__part")).alias("__last")).where("__last IS NOT NULL")
    shifts = shifts.select(F.col("__part").alias("__run"), *[F.col(c).alias(f"__by_{c}") for c in by], *shift.values())
    inside = W.partitionBy("__part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.withColumns({inner[n]: before(value[n], inside) for n in sums})
    same = F.col("__part") == F.col("__run")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = out.join(F.broadcast(shifts), same, "left")  # a part goes on with one earlier group at most, so a row per part
    return out.select(*df.columns, *[(F.col(inner[n]) + F.coalesce(shift[n], F.lit(0))).alias(n) for n in sums])


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Where a permutation of [0, n), one for each key, sends x: four Feistel rounds over a grid of about sqrt(n) by sqrt(n) cells,
    repeated while they leave [0, n). Images of 0, 1, ... are distinct, so the first k are a draw of k without a state."""
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    high = F.ceil(n / wide).cast("long")
    name = F.concat_ws("|", *[k.cast("string") for k in key])

    def hashed(turn: Column, v: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", name, turn.cast("string"), v.cast("string"))), 1, 13), 16, 10).cast("long")

    def once(v: Column) -> Column:  # written out, so that Spark compiles it
        at, rest = F.floor(v / high).cast("long"), F.pmod(v, high)
        for turn in (0, 2):
            at = F.pmod(at + hashed(F.lit(turn), rest), wide)
            rest = F.pmod(rest + hashed(F.lit(turn + 1), at), high)
        return at * high + rest

    def round_(s: Column, turn: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + hashed(turn, s["r"]), wide).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + hashed(turn, s["l"]), high).alias("r"))
        return F.when(turn % 2 == 0, left).otherwise(right)

    def again(v: Column) -> Column:
        begin = F.struct(F.floor(v / high).cast("long").alias("l"), F.pmod(v, high).alias("r"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(4)]), begin, round_, lambda s: s["l"] * high + s["r"])

    steps = F.sequence(F.lit(1), F.least(wide, F.lit(STEPS)).cast("int"))
    lost = F.raise_error(F.lit("a walk did not end")).cast("long")
    first = once(x.cast("long"))
    return F.when(first < n, first).otherwise(F.aggregate(steps, first, lambda v, _: F.when(v < n, v).otherwise(again(v)), lambda v: F.when(v < n, v).otherwise(lost)))


def placed(pool: DataFrame, order: list[Column | str]) -> DataFrame:
    """pool with place: 0, 1, ... in order."""
    return running(pool, [], order, {"place": F.lit(1).cast("long")})


def open_counts(segments: DataFrame, target: list[str], size: int) -> DataFrame:
    """(target, open): places in [0, size) that no segment (target, lo, len) covers. Segments of a target don't overlap."""
    return segments.groupBy(*target).agg((F.lit(size) - F.sum("len")).cast("long").alias("open"))


def running_in_blocks(df: DataFrame, by: list[str], block: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """running() for rows that have a whole number `block` that rises with order: a group's blocks are summed, then each is gone
    through alone, from the sum of those before it on. One shuffle of the rows; df is read twice. Null keys are a group."""
    value = {n: f"__value_{n}" for n in sums}
    rows = df.withColumns({value[n]: F.col(c).cast("long") for n, c in sums.items()}).withColumn("__first", F.lit(0))
    ahead = W.partitionBy(*by).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*by, block).agg(*[F.sum(v).alias(v) for v in value.values()])
    carried = totals.select(*by, block, *[F.sum(v).over(ahead).alias(v) for v in value.values()], F.lit(-1).alias("__first")).where(F.coalesce(*value.values()).isNotNull())
    inside = W.partitionBy(*by, block).orderBy("__first", *order).rowsBetween(W.unboundedPreceding, -1)
    every = rows.unionByName(carried, allowMissingColumns=True)
    out = every.select(*df.columns, "__first", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n) for n, v in value.items()])
    return out.where("__first = 0").drop("__first")


def _large(rows: DataFrame, target: list[str], at: str, end: str) -> DataFrame | None:
    """(target, __width, __top, __taken) of targets with over BLOCK segments, of which there is one for BLOCK rows at most: the width
    of a block, so that it has about a quarter of BLOCK of them, the last start and the length of all. None where there is none."""
    per = rows.groupBy(*target).agg(F.count("*").alias("__k"), F.max(at).alias("__top"), F.sum(end).alias("__taken")).where(F.col("__k") > BLOCK)
    per = per.select(*target, (F.floor(F.col("__top") / F.ceil(F.col("__k") * 4 / BLOCK)) + 1).cast("long").alias("__width"), "__top", "__taken").checkpoint()
    return None if per.isEmpty() else per


def _with_large(df: DataFrame, large: DataFrame, target: list[str]) -> DataFrame:
    other = large.withColumnsRenamed({c: f"__large_{c}" for c in target})
    same = F.lit(True)
    for c in target:
        same = same & F.col(c).eqNullSafe(F.col(f"__large_{c}"))
    return df.join(F.broadcast(other), same, "left").drop(*[f"__large_{c}" for c in target])  # a row for BLOCK rows at most


def starts(segments: DataFrame, target: list[str]) -> DataFrame:
    """(target, __at, __len): how many open places a target has before each of its segments (target, lo, len), which don't overlap.

    segments should be stored: they are read several times."""
    checkpoint_dir(segments.sparkSession)
    rows = segments.select(*target, F.col("lo").cast("long").alias("lo"), F.col("len").cast("long").alias("__len"))
    large = _large(rows, target, "lo", "__len")
    if large is None:
        before = F.sum("__len").over(W.partitionBy(*target).orderBy("lo").rowsBetween(W.unboundedPreceding, -1))
        out = rows.withColumn("__before", F.coalesce(before, F.lit(0)))
    else:
        rows = _with_large(rows, large, target)
        out = running_in_blocks(rows.withColumn("__block", F.coalesce(F.floor(F.col("lo") / F.col("__width")), F.lit(0))), target, "__block", ["lo"], {"__before": "__len"})
    return stored(out.select(*target, (F.col("lo") - F.col("__before")).alias("__at"), "__len"))


def at_ranks(started: DataFrame, draws: DataFrame, target: list[str], rank: str = "rank") -> DataFrame:
    """draws with place: the place of their rank-th open one (from 0) for their target, whose segments come as starts() made them.

    A segment shifts all ranks from its start on by its length. Segments and draws of a target are gone through in one order; a target
    of over BLOCK segments in blocks of ranks, each from the length of all earlier ones on. Ranks behind a large target's last segment
    are shifted by all of them.
    """
    rest = [c for c in draws.columns if c not in target]
    draw = F.struct(*rest).alias("__draw")
    marks = started.select(*target, "__at", F.lit(0).alias("__kind"), "__len")
    asked = draws.select(*target, F.col(rank).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__len"), draw)
    large = _large(started, target, "__at", "__len")
    if large is None:
        both = marks.withColumns({"__block": F.lit(0).cast("long"), "__taken": F.lit(None).cast("long")}).unionByName(asked.withColumns({"__block": F.lit(0).cast("long"), "__taken": F.lit(None).cast("long")}), allowMissingColumns=True)
    else:
        of = F.coalesce(F.floor(F.col("__at") / F.col("__width")), F.lit(0)).cast("long")
        marks = _with_large(marks, large, target).withColumn("__block", of)
        grid = large.select(*target, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__top") / F.col("__width")).cast("long"))).alias("__block"), F.lit(0).cast("long").alias("__len"))
        sums = marks.where("__width IS NOT NULL").select(*target, "__block", "__len").unionByName(grid).groupBy(*target, "__block").agg(F.sum("__len").alias("__len"))
        ahead = W.partitionBy(*target).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
        carried = sums.select(*target, "__block", F.sum("__len").over(ahead).alias("__len"), F.lit(-1).cast("long").alias("__at"), F.lit(0).alias("__kind")).where("__len IS NOT NULL")
        behind = F.col("__at") > F.col("__top")
        asked = _with_large(asked, large, target).withColumns({"__block": F.when(behind, -1 - of).otherwise(of), "__taken": F.when(behind, F.col("__taken"))}).drop("__width", "__top")
        both = marks.drop("__width", "__top", "__taken").unionByName(carried).unionByName(asked, allowMissingColumns=True)
    shift = F.sum("__len").over(W.partitionBy(*target, "__block").orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, -1))
    both = both.withColumn("__shift", F.coalesce("__taken", shift, F.lit(0))).where("__kind = 1")
    return both.select(*target, "__draw.*", (F.col("__at") + F.col("__shift")).alias("place")).select(*draws.columns, "place")


def open_places(segments: DataFrame, draws: DataFrame, target: list[str], rank: str = "rank") -> DataFrame:
    """at_ranks of segments (target, lo, len)."""
    return at_ranks(starts(segments, target), draws, target, rank)


def repeated(df: DataFrame, low: Column, high: Column, name: str, block: int = 1 << 14) -> DataFrame:
    """df with a row for each whole number from low to high - 1 in `name`. Long runs are cut into blocks, which are dealt over all tasks,
    so no task makes all rows of one. The number of parts is given, as Spark would else join them by the few bytes that they have
    before the rows are made."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.when(high > low, F.sequence(low, high - 1, F.lit(block).cast("long")))
    dealt = df.withColumn("__high", high).withColumn("__low", F.explode(blocks)).repartition(parts, F.xxhash64(*df.columns, "__low"))
    return dealt.withColumn(name, F.explode(F.sequence("__low", F.least(F.col("__low") + block, F.col("__high")) - 1))).drop("__low", "__high")
