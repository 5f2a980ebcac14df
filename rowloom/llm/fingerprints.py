"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits. DataFrame functions only.

Every shingle of five words is hashed once; the top bits of its hash name a bin and each bin keeps its least hash. An
empty bin takes the value of another, found by a fixed random order of bins of its own (its first TRIES members directly,
the rest by a hash of both bins), so that two sets with equal bins choose alike and the estimate stays unbiased. Each value is
hashed once more with its bin, so that bins with one value between them (short texts) don't agree by chance all at once,
and four bits of that are kept as one hex digit; likeness takes out the 1/16 of digits that agree by chance.

All steps are expressions on a row: no shingle leaves its row, so nothing is shuffled for a fingerprint.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.llm.common import let, with_floor

BINS, BITS, SHINGLE, TRIES = 256, 4, 5, 8
#: Bits of a 63-bit hash below its bin.
_LOW = 63 - BINS.bit_length() + 1
_MASK = (1 << _LOW) - 1
_SPACES = " \t\n\x0b\x0c\r"
_DIGITS = "0123456789abcdef"


def _long_array(values: list[int]) -> Column:
    return F.lit(np.array(values, np.int64))  # one literal, however long


def _tries() -> Column:
    """TRIES bins for each bin, one after the other."""
    rng = random.Random(5)
    return _long_array([b for j in range(BINS) for b in rng.sample([x for x in range(BINS) if x != j], TRIES)])


def shingle_hashes(text: Column) -> Column:
    """63-bit hashes of the word shingles; fewer words: of the whole sequence; no words or null: of one empty word."""
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES)), r"[\x20\x09-\x0D]+")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = lambda h: F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE, F.lit(0)))
    # places behind the end are null, which xxhash64 passes over
    return let(hashes, lambda h: F.transform(starts(h), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]), 1)))


def signature(text: Column) -> Column:
    """The value of every bin, empty ones filled, as array<bigint> of BINS."""
    bin_of = lambda v: F.shiftrightunsigned(v, _LOW)
    full = lambda v: v.bitwiseAND(F.lit(_MASK)) != F.lit(_MASK)
    # a largest value for each bin, so that every bin has a first one after sorting
    ends = _long_array([(b << _LOW) | _MASK for b in range(BINS)])
    ordered = F.sort_array(F.concat(shingle_hashes(text), ends))
    least = let(ordered, lambda s: F.filter(s, lambda v, i: (i == 0) | (bin_of(v) != bin_of(F.get(s, i - 1)))))
    tries = _tries()

    def fill(d: Column) -> Column:
        taken = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: full(F.get(d, b)))

        def donor(j: Column, some: Column) -> Column:
            first = F.get(F.filter(F.transform(F.slice(tries, j * TRIES + 1, TRIES), lambda b: F.get(d, b.cast("int"))), full), F.lit(0))
            # the hash of both bins with the donor in its last bits
            ranks = F.transform(some, lambda b: F.xxhash64(j, b).bitwiseAND(F.lit(-BINS)).bitwiseOR(b.cast("long")))
            return F.coalesce(first, F.get(d, F.array_min(ranks).bitwiseAND(F.lit(BINS - 1)).cast("int")))

        return let(taken, lambda some: F.transform(d, lambda v, j: F.when(full(v), v).otherwise(donor(j, some))))

    return let(least, fill)


def fingerprint(text: Column) -> Column:
    """BINS hex digits; equal texts, equal fingerprints."""
    low = lambda v, j: F.xxhash64(v, j).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    digits = F.transform(signature(text), lambda v, j: F.substring(F.lit(_DIGITS), low(v, j) + 1, F.lit(1)))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of shingles in common, 0 to 1, from the digits that agree less those that agree by chance."""
    chance = 1 / (1 << BITS)
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / BINS - chance) / (1 - chance)))


def with_next(rows: DataFrame, id_col: str, ties: list[Column], buckets: int | None = None):
    """(rows in ranges of ids, lead): lead(columns, frame) adds next_<c> for each c of columns, its value in the row next in
    descending id order (after the last: in the first); rows(frame) drops what was added for that.

    Ranges of ids are the window partitions, so no task sees more than its range: bounds are approximate quantiles of the
    ids (a few kilobytes at the driver), a row finds its range by binary search, and the first row of each range goes as a
    guest to the range before it as well. One shuffle, whatever is computed and led after it. Null ids come last; rows of
    equal ids are ordered by `ties`.
    """
    # several ranges a partition, so that partitions come out alike
    buckets = 1 << ((buckets or 4 * with_floor(rows, 1)) - 1).bit_length()
    ids = rows.select(F.col(id_col).alias("id"))
    bounds = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else []
    if bounds is None:
        buckets, bounds = 1, []
    at = F.lit(0)
    if bounds:
        table, step = _long_array([int(b) for b in bounds]), buckets // 2
        steps = []
        while step:
            steps.append(step)
            step //= 2
        find = lambda pos, s: F.when(F.get(table, pos + s - 1) <= F.col(id_col), pos + s).otherwise(pos)
        at = F.when(F.col(id_col).isNull(), 0).otherwise(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), find))
    placed = rows.withColumn("__at", at)
    heads = sorted((r["__at"], r.id) for r in placed.groupBy("__at").agg(F.max(id_col).alias("id")).collect())
    guests = {b: (heads[(k + 1) % len(heads)][0], top) for k, (b, top) in enumerate(heads)}
    headless = [b for b, g in guests.items() if g[1] is None]  # null ids only

    def of(k: int) -> Column:
        known = F.get(_long_array([guests[b][k] if b in guests and guests[b][k] is not None else 0 for b in range(buckets)]), F.col("__at"))
        return F.when(F.col("__at").isin(headless), None).otherwise(known) if k and headless else known

    here = F.struct(F.col("__at").cast("long").alias("at"), F.lit(False).alias("guest"))
    there = F.struct(of(0).alias("at"), F.lit(True).alias("guest"))
    both = F.when(F.col(id_col).eqNullSafe(of(1)), F.array(here, there)).otherwise(F.array(here))
    # the keys are columns of their own, so that all windows have one exchange and one sort
    added = {"__range": F.col("__p.at"), "__guest": F.col("__p.guest")} | {f"__tie{k}": t for k, t in enumerate(ties)}
    placed = placed.select("*", F.explode(both).alias("__p")).withColumns(added).drop("__p", "__at")
    order = W.partitionBy("__range").orderBy("__guest", F.col(id_col).desc_nulls_last(), *list(added)[2:])

    def lead(columns: list[str], frame: DataFrame) -> DataFrame:
        return frame.withColumn("__next", F.lead(F.struct(*columns)).over(order)).withColumns({f"next_{c}": F.col(f"__next.{c}") for c in columns}).drop("__next")

    return placed, lead, lambda frame: frame.where("NOT __guest").drop(*added)


def edited_text(text: Column, next_text: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of next_text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row; null texts are empty.

    Repeated rows each keep their row, ordered by length and hash among equal ids. A single row is its own next one. An
    empty table gives an empty one. A text without words is like another such text (1) and unlike the rest.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed, lead, own = with_next(rows, "doc_id", [F.char_length("text"), F.xxhash64("text")])
    # texts move once; fingerprints are made where they arrive, in as many tasks as there are ranges, and led in the same order
    out = own(lead(["fp"], lead(["text"], placed).withColumn("fp", fingerprint(F.col("text")))))
    out = out.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(F.col("edited")).alias("edited_fp"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
