"""Negative examples: hash-drawn donors that no known pair blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.operators.components import checkpoint_dir, stored
from rowloom.operators.open_draws import drawn_places
from rowloom.operators.ranks import BLOCK, at_ranks, open_counts, open_places, permuted, placed, repeated, running, running_in_blocks, starts

#: Slices of targets, gone through one after the other where there are many single places.
SLICES = 8
#: Rows of a pool that a task orders, about.
POOL_PART = 1 << 20


def numbered_pool(pool: DataFrame, ab: str = "ab", extra: list[str] | None = None) -> DataFrame:
    """(idx from 0, ab, ...): distinct donors in order of ab. Ranks come from counts per leading hash digits; no task orders the pool."""
    columns = [ab, *(extra or [])]
    parts = max(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), pool.count() // POOL_PART)
    hashed = pool.select(*columns).withColumn("__h", F.md5(F.concat_ws("|", *columns))).withColumn("__p", F.substring("__h", 1, 3))
    rank = F.row_number().over(W.partitionBy("__p").orderBy("__h", *columns)) - 1
    donors = stored(hashed.repartition(parts, "__p").distinct().select("__p", rank.alias("__rank"), *columns))
    sizes = sorted((r[0], r[1]) for r in donors.groupBy("__p").count().collect())  # at most 16 ** 3 rows
    first, before = [], 0
    for p, n in sizes:
        first.append((p, before))
        before += n
    first = pool.sparkSession.createDataFrame(first, "__p string, __before long")
    return donors.join(F.broadcast(first), "__p").select((F.col("__rank") + F.col("__before")).alias("idx"), *columns)


def draw_index(size: int, *key: Column) -> Column:
    """A hash-drawn place in [0, size)."""
    return F.floor(S.hash_uniform(*key) * size).cast("long")


def drawn_negatives(rows: DataFrame, pool: DataFrame, blocked: DataFrame, seed: int = 42, pep: str = "pep", ab: str = "ab", tries: int | None = None) -> DataFrame:
    """rows (pep and any keys that make them distinct) each with a donor ab that isn't blocked for its pep, exactly or by endpoint group;
    null where no donor is left.

    One draw of distinct_negatives for each row: nothing is drawn again, so `tries`, which older callers give, has no effect.
    """
    found, none = _draws(rows, pool, blocked, 1, seed, pep, ab, [])
    return found.drop("draw").unionByName(none.withColumn(ab, F.lit(None).cast(pool.schema[ab].dataType)))


def numbered_donors(pool: DataFrame, ab: str = "ab") -> DataFrame:
    """(__grp, ab, place): the distinct donors, numbered from 0 by endpoint group, then ab."""
    donors = pool.select(ab).distinct().select(S.endpoint_group(F.col(ab)).alias("__grp"), ab)
    return stored(running(donors, [], ["__grp", ab], {"place": F.lit(1).cast("long")}))


def negatives_by_place(rows: DataFrame, donors: DataFrame, shut: DataFrame, seed: int = 42, pep: str = "pep", ab: str = "ab") -> DataFrame:
    """drawn_negatives, where numbered_donors() made donors and the distinct places that a peptide may not have are in shut (pep, place),
    which should be stored: they are not looked for again."""
    checkpoint_dir(rows.sparkSession)
    segments = shut.select(pep, F.col("place").alias("lo"), F.lit(1).cast("long").alias("len"))
    field = _Field(donors, segments, donors.agg(F.count("*").alias("__size")), [], pep, "__grp", False)
    found, none = _drawn(field, rows, 1, seed, ab)
    return found.drop("draw").unionByName(none.withColumn(ab, F.lit(None).cast(donors.schema[ab].dataType)))


def ranked_negatives(peptides: DataFrame, pool: DataFrame, blocked: DataFrame, wanted: str, seed: int = 42, pep: str = "pep", ab: str = "ab", distinct_groups: bool = False) -> DataFrame:
    """(pep, ab, k): for each peptide the first `wanted` (a column of peptides) admissible donors of the pool in hash order, from
    a place that the peptide's own hash draws, and round the end.

    What comes from there on are the open ranks from that of the place on, so only draws and blocked places are looked at: work goes
    with wanted and blocked pairs, never with peptides times pool. distinct_groups: an endpoint group has one donor in the pool, its
    first in hash order. Fewer admissible donors than wanted give as many rows.
    """
    checkpoint_dir(pool.sparkSession)
    donors = pool.select(ab).distinct().withColumn("__grp", S.endpoint_group(F.col(ab)))
    if distinct_groups:
        donors = donors.groupBy("__grp").agg(F.min_by(ab, F.struct(F.md5(ab), F.col(ab))).alias(ab))
    donors = donors.checkpoint()
    numbered = numbered_pool(donors, ab).join(donors, ab).checkpoint()
    size = numbered.count()
    groups = blocked.select(pep, S.endpoint_group(F.col(ab)).alias("__grp")).distinct()  # a blocked donor is in its group
    closed = groups.join(numbered, "__grp").select(pep, F.col("idx").alias("lo"), F.lit(1).cast("long").alias("len")).checkpoint()
    start = draw_index(max(size, 1), F.lit(str(seed)), F.col(pep))
    counts = closed.groupBy(pep).agg(F.count("*").alias("__closed"), F.count_if(F.col("lo") < start).alias("__before"))
    asked = _null_safe(peptides.select(pep, F.col(wanted).cast("long").alias("__wanted")), counts, [pep])
    asked = asked.select(pep, "__wanted", (F.lit(size) - F.coalesce("__closed", F.lit(0))).alias("__open"), (start - F.coalesce("__before", F.lit(0))).alias("__from"))
    asked = repeated(asked, F.lit(0).cast("long"), F.least("__wanted", "__open"), "__step")
    ranked = asked.select(pep, (F.col("__step") + 1).cast("int").alias("k"), F.pmod(F.col("__from") + F.col("__step"), F.col("__open")).alias("__rank"))
    found = at_ranks(starts(closed, [pep]), ranked, [pep], "__rank")
    return found.join(numbered, F.col("place") == F.col("idx")).select(pep, ab, "k")


def recombined(rows: DataFrame, known: DataFrame, key: str, left: str, right: str, seed: int = 42) -> DataFrame:
    """(left, right, n): each row's left with the right of a row that its hash draws, so both come by their frequency; pairs of
    `known` are left out. key (a text) tells rows apart."""
    checkpoint_dir(rows.sparkSession)
    same = known is rows
    rows = stored(rows.select(key, left, right))
    known = rows if same else known
    numbered = stored(numbered_pool(rows, key, [right]))
    size = max(1, numbered.count())
    drawn = rows.select(key, left).distinct().withColumn("idx", draw_index(size, F.lit(str(seed)), F.col(key)))
    pairs = drawn.join(numbered.select("idx", right), "idx").groupBy(left, right).agg(F.count("*").alias("n"))
    return pairs.join(known.select(left, right).distinct(), [left, right], "left_anti")


def other_targets(rows: DataFrame, target: str, a: str = "a", b: str = "b") -> DataFrame:
    """(target, n): how many distinct receptors (a, b) of all rows share neither chain with any of the target's own.

    By what share a, share b, or share both, so targets and receptors are never paired. Targets with none have no row.
    """
    rows = stored(rows.select(target, a, b).distinct())
    every = rows.select(a, b).distinct()
    own_a, own_b = rows.select(target, a).distinct(), rows.select(target, b).distinct()
    degree = lambda c: every.groupBy(c).agg(F.count("*").alias("__d"))
    share_a = own_a.join(degree(a), a).groupBy(target).agg(F.sum("__d").alias("__a"))
    share_b = own_b.join(degree(b), b).groupBy(target).agg(F.sum("__d").alias("__b"))
    both = own_a.join(every, a).join(own_b, [target, b], "left_semi").groupBy(target).agg(F.count("*").alias("__both"))
    total = every.agg(F.count("*").alias("__n"))
    out = share_a.join(share_b, target).join(both, target).join(F.broadcast(total))  # one row
    return out.select(target, (F.col("__n") - F.col("__a") - F.col("__b") + F.col("__both")).alias("n")).where("n > 0")


def balanced(df: DataFrame, cells: list[str], key: list[str], seed: int = 42) -> DataFrame:
    """Rows so that every cell has as many as the smallest: those of the least hashes.

    Counts per cell and leading hash digits tell which digits stay whole and which go; only rows of the digits on the border
    are ranked, so a large cell isn't ordered in one task.
    """
    order = S.hash_order(seed, *[F.col(k) for k in key])
    rows = df.withColumn("__h", order).withColumn("__p", F.substring("__h", 1, 3))
    per = rows.groupBy(*cells, "__p").agg(F.count("*").alias("__n"))  # at most 16 ** 3 rows a cell
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*cells).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    least = per.groupBy(*cells).agg(F.sum("__n").alias("__s")).agg(F.min("__s").alias("__least"))
    plan = per.withColumn("__before", before).join(F.broadcast(least)).where("__before < __least").select(*[F.col(c).alias(f"__{c}") for c in cells], F.col("__p").alias("__q"), "__before", "__least", (F.col("__before") + F.col("__n") > F.col("__least")).alias("__border"))
    same = F.col("__p") == F.col("__q")
    for c in cells:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    kept = rows.join(plan, same)
    place = F.row_number().over(W.partitionBy(*cells).orderBy("__h", *key)) + F.col("__before")
    edge = kept.where("__border").withColumn("__at", place).where("__at <= __least")
    return kept.where("NOT __border").select(*df.columns).unionByName(edge.select(*df.columns))


def weighted_order(weight: Column, *key: Column) -> Column:
    """-ln(u) / weight: the least values are a weighted draw without replacement."""
    return -F.log(F.greatest(S.hash_uniform(*key), F.lit(1e-12))) / weight


def masked_chains(df: DataFrame, columns: list[str], share: float, key: list[str], seed: int = 42, mark: str = "<MIS>") -> DataFrame:
    """Each column masked with probability share by a hash of its name and the key."""
    draw = {c: S.hash_uniform(F.lit(str(seed)), F.lit(c), *[F.col(k) for k in key]) for c in columns}
    return df.withColumns({c: F.when(draw[c] < share, mark).otherwise(F.col(c)) for c in columns})


class _Field:
    """A numbered pool and what each target may not draw from it. Donors of a unit have neighbouring places within their domain, so a
    target is shut out of a segment for each of its units, whatever they hold."""

    def __init__(self, donors: DataFrame, segments: DataFrame, sizes: DataFrame, within: list[str], target: str, unit: str, single: bool):
        """donors: (within, unit, payload ..., place); segments, stored: (within, target, lo, len), none of a target overlapping; sizes:
        (within, __size); single: whether each donor is a unit of its own."""
        self.donors, self.sizes, self.single = donors, sizes, single
        self.within, self.target, self.unit, self.on = within, target, unit, [*within, target]
        self.starts = starts(segments, self.on)

    @classmethod
    def numbered(cls, donors: DataFrame, shut: DataFrame, within: list[str], target: str, unit: str, times: str | None = None) -> _Field:
        """donors: (within, unit, payload ...), each a place, or (within, unit, times) with `times` places for a unit; shut: (target, unit)."""
        if times:
            units = running(donors, within, [unit], {"lo": F.col(times)}).select(*within, unit, "lo", F.col(times).alias("len")).checkpoint()
            donors = repeated(units, F.col("lo"), F.col("lo") + F.col("len"), "place").drop("lo", "len")
        else:
            order = [unit, *[c for c in donors.columns if c not in (*within, unit)]]
            donors = running(donors, within, order, {"place": F.lit(1).cast("long")}).checkpoint()
            units = donors.groupBy(*within, unit).agg(F.min("place").alias("lo"), F.count("*").alias("len"))
        segments = stored(shut.select(target, unit).distinct().join(units, unit).select(*within, target, "lo", "len"))
        sizes = units.groupBy(*within).agg(F.sum("len").alias("__size"))
        return cls(donors, segments, sizes, within, target, unit, units.where("len > 1").isEmpty())

    def opened(self, rows: DataFrame) -> DataFrame:
        """rows with __open: donors of their domain that are open to their target."""
        taken = self.starts.groupBy(*self.on).agg(F.sum("__len").alias("__taken"))
        if self.within:
            out = _null_safe(rows, self.sizes, self.within)
        else:
            out = rows.withColumn("__size", F.lit(self.sizes.first()[0] or 0).cast("long"))
        out = _null_safe(out, taken, self.on)
        return out.withColumn("__open", (F.coalesce("__size", F.lit(0)) - F.coalesce("__taken", F.lit(0))).cast("long")).drop("__size", "__taken")

    def drawn(self, asked: DataFrame, image: str, key: list[Column], again: Column | None = None) -> DataFrame:
        """asked (with __open) with the donor that the key's permutation has at `image`; where `again` holds, any open one by a hash."""
        rank = permuted(F.col(image), F.col("__open"), *key)
        if again is not None:
            rank = F.when(again, F.floor(S.hash_uniform(*key, F.lit("again"), F.col(image)) * F.col("__open")).cast("long")).otherwise(rank)
        found = at_ranks(self.starts, asked.withColumn("__rank", rank).drop("__open"), self.on, "__rank")
        names = [c for c in self.donors.columns if c not in ("place", *self.within)]
        donors = self.donors.select(F.col("place").alias("__place"), *[F.col(c).alias(f"__own_{c}") for c in self.within], F.struct(*names).alias("__donor"))
        same = F.col("place") == F.col("__place")
        for c in self.within:
            same = same & F.col(c).eqNullSafe(F.col(f"__own_{c}"))
        return found.join(donors, same).select(*[c for c in asked.columns if c != "__open"], "__donor")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on keys in which nulls are equal; the right side's keys are dropped."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(other[f"__right_{k}"])
    return left.join(other, same, how).drop(*[f"__right_{k}" for k in keys])


def _by_group(pool: DataFrame, blocked: DataFrame, within: list[str], pep: str, ab: str) -> _Field:
    grp = S.endpoint_group(F.col(ab)).alias("__grp")
    return _Field.numbered(pool.select(*within, ab).distinct().select(*within, grp, ab), blocked.select(pep, grp), within, pep, "__grp")


def _key_of(rows: DataFrame, seed: int) -> list[Column]:
    return [F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]]


def _draws(rows: DataFrame, pool: DataFrame, blocked: DataFrame, times: int | str, seed: int, pep: str, ab: str, within: list[str]) -> tuple[DataFrame, DataFrame]:
    """distinct_negatives, and the rows of peptides for which no donor is open."""
    checkpoint_dir(rows.sparkSession)
    return _drawn(_by_group(pool, blocked, within, pep, ab), rows, times, seed, ab)


def _drawn(field: _Field, rows: DataFrame, times: int | str, seed: int, ab: str) -> tuple[DataFrame, DataFrame]:
    wanted = (F.lit(times) if isinstance(times, int) else F.col(times)).cast("long")
    opened = field.opened(rows)
    none = opened.where("__open = 0").select(*rows.columns)
    asked = repeated(opened, F.lit(0).cast("long"), F.least(wanted, F.col("__open")), "draw")
    found = field.drawn(asked, "draw", _key_of(rows, seed))
    return found.select(*rows.columns, "draw", F.col("__donor")[ab].alias(ab)), none


def _first_units(rows: DataFrame, field: _Field, wanted: str, seed: int) -> DataFrame:
    """(rows, __unit, __donor, draw): for each row the first `wanted` distinct units that its permutation of open donors meets, numbered
    from 0, each with the donor that it was met by; all units where fewer are open.

    A unit comes by the number of its open donors, without replacement. Rows look at twice as many donors as they want, then at
    as many again while units are missing and donors left.
    """
    key = _key_of(rows, seed)
    wanted_ = F.col(wanted).cast("long")
    opened = field.opened(rows).where(F.col("__open") > 0)
    if field.single:  # each donor is another unit
        asked = repeated(opened, F.lit(0).cast("long"), F.least(F.col("__open"), wanted_), "draw")
        return field.drawn(asked, "draw", key).select(*rows.columns, F.col("__donor")[field.unit].alias("__unit"), "__donor", "draw")
    opened = opened.withColumn("__to", F.least(F.col("__open"), 2 * wanted_ + 8)).withColumn("__from", F.lit(0).cast("long")).checkpoint()
    todo, met = opened, None
    while not todo.isEmpty():
        asked = repeated(todo, F.col("__from"), F.col("__to"), "__image").drop("__from", "__to")
        new = field.drawn(asked, "__image", key).select(*rows.columns, F.col("__donor")[field.unit].alias("__unit"), F.struct("__image", "__donor").alias("__met"))
        met = (new if met is None else met.unionByName(new)).groupBy(*rows.columns, "__unit").agg(F.min("__met").alias("__met")).checkpoint()
        have = met.groupBy(*rows.columns).agg(F.count("*").alias("__have"))
        short = _null_safe(todo, have, rows.columns, "left").where((F.coalesce("__have", F.lit(0)) < F.col(wanted)) & (F.col("__to") < F.col("__open")))
        todo = short.drop("__have").withColumn("__from", F.col("__to")).withColumn("__to", F.least(F.col("__open"), 2 * F.col("__to"))).checkpoint()
    if met is None:
        empty = field.drawn(opened.withColumn("__image", F.col("__from")), "__image", key)
        met = empty.select(*rows.columns, F.col("__donor")[field.unit].alias("__unit"), F.struct("__image", "__donor").alias("__met"))
    met = met.select(*rows.columns, "__unit", "__met.__image", "__met.__donor").withColumns({"__block": F.floor(F.col("__image") / 16384), "__one": F.lit(1)})
    return running_in_blocks(met, rows.columns, "__block", ["__image"], {"draw": "__one"}).where(F.col("draw") < F.col(wanted)).drop("__image", "__block", "__one")


def distinct_negatives(rows: DataFrame, pool: DataFrame, blocked: DataFrame, times: int | str = 1, seed: int = 42, pep: str = "pep", ab: str = "ab", within: list[str] | None = None) -> DataFrame:
    """(columns of rows, draw, ab): for each row `times` distinct donors, drawn evenly from those that no blocked pair of its pep rules
    out, exactly or by endpoint group; fewer only where fewer exist. times: a number, or a column of rows. draw counts from 0.

    within: columns that rows and pool share (a domain): donors come from the row's own; what is blocked is so in all domains.
    A keyed permutation of a peptide's open ranks names the draws, and a running sum over blocked segments and draws finds
    their places: no redraws, no pairing of peptides and pool. A row's draws depend on seed and row alone. Rows should be
    distinct; equal rows get equal draws. A null peptide or domain is one like any other.
    """
    return _draws(rows, pool, blocked, times, seed, pep, ab, within or [])[0]


def evaluation_negatives(positives: DataFrame, pool: DataFrame, known: DataFrame, seed: int = 42, pep: str = "pep", allele: str = "mhc", ab: str = "ab", strict: bool = True) -> DataFrame:
    """(pep, allele, draw, grp, ab): as many negatives for each (pep, allele) as it has rows in positives, no endpoint group twice.

    A donor is drawn evenly from those of the pool whose group is in no known pair of the peptide, whatever the allele, and drawn
    again where its group was met before; so a group comes by the number of its donors and any of them may stand for it.
    strict: an error where groups run out, as positives and negatives would not be one to one; else fewer.
    """
    checkpoint_dir(positives.sparkSession)
    rows = positives.groupBy(pep, allele).agg(F.count("*").alias("__wanted")).checkpoint()
    field = _by_group(pool, known, [], pep, ab)
    found = _first_units(rows, field, "__wanted", seed).checkpoint()
    if strict:
        got = found.groupBy(pep, allele).agg(F.count("*").alias("__got"))
        short = _null_safe(rows, got, [pep, allele]).where(F.coalesce("__got", F.lit(0)) < F.col("__wanted")).select(pep, allele).limit(5).collect()
        if short:
            raise ValueError(f"not enough negative groups for {[tuple(r) for r in short]} and maybe others")
    return found.select(pep, allele, "draw", F.col("__unit").alias("grp"), F.col("__donor")[ab].alias(ab))


def shuffled_negatives(rows: DataFrame, target: str, receptor: str, ratio: float, seed: int = 42) -> DataFrame:
    """(target, draw, receptor): for each target floor(its rows * ratio) receptors of the table that no row has it with, all distinct if as many
    exist; else each is drawn anew, so some come again. A target that has every receptor gets none. Null receptors are none.
    """
    checkpoint_dir(rows.sparkSession)
    wanted = rows.groupBy(target).agg(F.floor(F.count("*") * F.lit(float(ratio))).cast("long").alias("__wanted")).checkpoint()
    field = _Field.numbered(rows.where(F.col(receptor).isNotNull()).select(receptor).distinct(), rows.select(target, receptor), [], target, receptor)
    asked = repeated(field.opened(wanted).where("__open > 0"), F.lit(0).cast("long"), F.col("__wanted"), "draw")
    found = field.drawn(asked, "draw", _key_of(wanted, seed), F.col("__wanted") > F.col("__open"))
    return found.select(target, "draw", F.col("__donor")[receptor].alias(receptor))


def recombined_to_quota(rows: DataFrame, left: str, right: str, ratio: float, known: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(left, right, draw): for each left round(its rows * ratio) new pairs with distinct rights, halves to even; all there are where fewer
    exist. A right comes by its rows among all, and never one that the left has in known (rows, if not given).

    Every row is a donor of its right: drawing rows without replacement and passing over rights met before is drawing rights by
    frequency until the quota is full. Null rights are no donors.
    """
    checkpoint_dir(rows.sparkSession)
    quota = rows.groupBy(left).agg(F.bround(F.count("*") * F.lit(float(ratio))).cast("long").alias("__wanted")).where("__wanted > 0").checkpoint()
    every = rows.where(F.col(right).isNotNull()).groupBy(right).agg(F.count("*").alias("__times"))
    field = _Field.numbered(every, (rows if known is None else known).select(left, right), [], left, right, "__times")
    return _first_units(quota, field, "__wanted", seed).select(left, F.col("__unit").alias(right), "draw")


def other_target_negatives(rows: DataFrame, target: str, a: str = "a", b: str = "b", times: int = 1, seed: int = 42) -> DataFrame:
    """(target, a, b, draw, other_a, other_b): for each distinct positive (target, a, b) `times` distinct receptors of any target that
    share neither chain with the target's own; fewer only where fewer exist.

    Receptors are numbered so that most of what a target is blocked from is a segment: by their first chain, and those with
    a common second chain (more than sqrt(receptors) of them) by that one. What is left are single places, at most sqrt(receptors) for
    each chain of a target. They are kept as a list for each chain, which a target takes whole, and targets are gone through in
    slices, so that the lists of one slice are on disk at a time. A target with over BLOCK places is gone through in blocks of
    ranks. Draws and places as in distinct_negatives. Chains and targets are not null.
    """
    spark = rows.sparkSession
    kind_a, kind_b = rows.schema[a].dataType, rows.schema[b].dataType
    own = stored(rows.select(target, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct())
    every = stored(own.select("a", "b").distinct())
    size = every.count()
    common = every.groupBy("b").agg((F.count("*") > F.ceil(F.sqrt(F.lit(float(size))))).cast("int").alias("part"))
    x, y = (F.when(F.col("part") == 0, F.col(one)).otherwise(F.col(other)) for one, other in (("a", "b"), ("b", "a")))
    pool = stored(placed(every.join(common, "b").select("part", x.alias("x"), y.alias("y")), ["part", "x", "y"]))
    whole = stored(pool.groupBy("part", "x").agg(F.min("place").alias("lo"), F.count("*").alias("len")))
    number = F.col("place").cast("int" if size < 1 << 31 else "bigint")
    lists = stored(pool.groupBy("part", "y").agg(F.collect_list(number).alias("places"), F.count("*").alias("n")))
    of_part = lambda df, part, old, new: df.where(F.col("part") == part).withColumnRenamed(old, new).drop("part")
    chains = lambda of: ((0, "a", "b", of.select(target, "a").distinct(), of.select(target, "b").distinct()), (1, "b", "a", of.select(target, "b").distinct(), of.select(target, "a").distinct()))

    counts = None
    for part, _, c, _, theirs in chains(own):
        n = theirs.join(of_part(lists.select("part", "y", "n"), part, "y", c), c).select(target, "n")
        counts = n if counts is None else counts.unionByName(n)
    counts = counts.groupBy(target).agg(F.sum("n").alias("n"))
    large = counts.where(F.col("n") > BLOCK).select(target)
    singles, hot = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > BLOCK)).first()
    rest, found = own, []
    if hot:
        large = stored(large)
        rest, mine = own.join(large, target, "left_anti"), own.join(large, target, "left_semi")
        found.append(stored(_large_targets(mine, pool, chains(mine), whole, target, size, times, seed)))
    slices = min(SLICES, 1 + (singles >> 24))
    for k in range(slices):
        mine = rest.where(F.pmod(F.xxhash64(target), F.lit(slices)) == k)
        runs = shut = None
        for part, one, c, ours, theirs in chains(mine):
            run = ours.join(of_part(whole, part, "x", one), one).select(target, "lo", "len")
            listed = theirs.join(of_part(lists, part, "y", c), c).select(target, "places")
            runs, shut = (run, listed) if runs is None else (runs.unionByName(run), shut.unionByName(listed))
        drawn = drawn_places(runs, shut, mine, target, size, times, seed)
        found.append(stored(drawn.select(target, F.col("a").cast(kind_a).alias("a"), F.col("b").cast(kind_b).alias("b"), "draw", "place")))
    out = None
    for part in found:
        part = part.select(target, F.col("a").cast(kind_a).alias("a"), F.col("b").cast(kind_b).alias("b"), "draw", "place")
        out = part if out is None else out.unionByName(part)
    x, y = (F.when(F.col("part") == 0, F.col(one)).otherwise(F.col(two)) for one, two in (("x", "y"), ("y", "x")))
    others = pool.select("place", x.cast(kind_a).alias("other_a"), y.cast(kind_b).alias("other_b"))
    return out.join(others, "place").select(target, F.col("a").alias(a), F.col("b").alias(b), "draw", "other_a", "other_b")


def _large_targets(own: DataFrame, pool: DataFrame, chains: tuple, whole: DataFrame, target: str, size: int, times: int, seed: int) -> DataFrame:
    """(target, a, b, draw, place) of other_target_negatives for targets with any number of single places, each a row."""
    segments = None
    for part, one, other, mine, theirs in chains:
        run = mine.join(whole.where(F.col("part") == part).withColumnRenamed("x", one), one).select(target, "lo", "len")
        here = pool.where(F.col("part") == part).withColumnsRenamed({"x": one, "y": other})
        single = theirs.join(here, other).join(mine, [target, one], "left_anti").select(target, F.col("place").alias("lo"), F.lit(1).cast("long").alias("len"))
        segments = run.unionByName(single) if segments is None else segments.unionByName(run).unionByName(single)
    segments = segments.checkpoint()
    asked = own.join(open_counts(segments, [target], size), target).withColumn("__n", F.least(F.lit(times).cast("long"), F.col("open"))).where("__n > 0")
    asked = repeated(asked, F.lit(0).cast("long"), F.col("__n"), "draw")
    asked = asked.select(target, "a", "b", "draw", permuted(F.col("draw"), F.col("open"), F.lit(seed), F.col(target), F.col("a"), F.col("b")).alias("rank"))
    return open_places(segments, asked, [target]).select(target, "a", "b", "draw", "place")
