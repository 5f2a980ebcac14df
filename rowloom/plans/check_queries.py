"""What draws and greedy choices must hold, as queries with SQL: counts, and rules whose breaches are 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.operators.joins import key_overlaps
from rowloom.plans.plan_queries import prepared
from rowloom.plans.registry import QUERIES, add, pairs
from rowloom.plans.split_queries import _QUOTA_SQL

_KEY = ["pep", "mhc", "grp"]


def _of(name):
    return lambda s, d: QUERIES[name](s, d)


def _flag(s, d, flag):
    return pairs(s, d).where(F.col("l_returnflag") == flag)


def _pair_choice(s, d):
    """Pairs chosen of each peptide, of which none is missing in the corpus, and whether the peptide keeps some for training."""
    keys = pairs(s, d).groupBy(*_KEY).agg(F.lit(1).alias("known"))
    chosen = _of("G1_pair_validation")(s, d).select(*_KEY, F.lit(1).alias("chosen"))
    per = keys.join(chosen, _KEY, "full").groupBy("pep")
    return per.agg(F.count("chosen").alias("quota"), F.count_if(F.col("known").isNull()).alias("unknown"), (F.count("*") > F.count("chosen")).alias("trains"))


add("G1_pair_choice_rules", _pair_choice, _QUOTA_SQL.replace("SELECT pep, n, (base", "SELECT pep, coalesce(quota, 0)::BIGINT AS quota, 0 AS unknown, TRUE AS trains FROM p LEFT JOIN (SELECT pep, (base").replace("AS quota FROM r", "AS quota FROM r) USING (pep)"))


def _subset(s, d):
    sizes = pairs(s, d).groupBy("brand").agg(F.count("*").alias("n"))
    held = _of("G2_group_subset")(s, d).select("brand", F.lit(1).alias("held"))
    out = sizes.join(held, "brand", "full").agg(F.sum(F.when(F.col("held") == 1, F.col("n"))).alias("__sum"), F.sum("n").alias("rows"), F.min("n").alias("__least"), F.count_if(F.col("n").isNull()).alias("unknown"))
    return out.select("rows", "unknown", (F.abs(F.col("__sum") - F.col("rows") * 0.1) <= F.col("__least") / 2).alias("near"))


add("G2_group_subset_rules", _subset, "{P} SELECT count(*) AS rows, 0 AS unknown, TRUE AS near FROM pairs")
add("G3_selection_rules", lambda s, d: _of("G3_selection_report")(s, d).agg(F.sum("rows").alias("rows"), F.sum("peptides").alias("peptides"), F.count("*").alias("parts")), "{P} SELECT count(*) AS rows, count(DISTINCT pep) AS peptides, 2 AS parts FROM pairs")


def _rejection(s, d):
    per = pairs(s, d).groupBy("pep").agg(F.count("*").alias("n"))
    found = _of("G6_rejection_partition")(s, d)
    cap = pairs(s, d).agg(F.floor(F.count("*") / 5).alias("cap"))
    out = found.join(per, "pep", "left").groupBy("split").agg(F.countDistinct("pep").alias("peptides"), F.sum("n").alias("__n"), F.count_if(F.col("n").isNull()).alias("unknown"))
    twice = found.groupBy("pep").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("shared"))
    return out.join(F.broadcast(cap)).join(F.broadcast(twice)).select("split", "peptides", "unknown", "shared", (F.col("__n") <= F.col("cap") * 1.05).alias("within"))  # one row each


add("G6_rejection_rules", _rejection, "{P} SELECT split, greatest(1, count(DISTINCT pep) // 6) AS peptides, 0 AS unknown, 0 AS shared, TRUE AS within FROM pairs, (VALUES ('valid'), ('test')) v(split) GROUP BY split")


def _folds(s, d):
    sizes = pairs(s, d).groupBy("brand").agg(F.count("*").alias("n"))
    found = sizes.join(_of("G11_group_folds")(s, d), "brand", "full")
    per = found.groupBy("fold").agg(F.sum("n").alias("rows"), F.count("*").alias("brands"), F.max("n").alias("most"))
    return per.agg(F.sum("rows").alias("rows"), F.sum("brands").alias("brands"), F.count("fold").alias("folds"), (F.max("rows") - F.min("rows") <= F.max("most")).alias("balanced"))


add("G11_group_fold_rules", _folds, "{P} SELECT count(*) AS rows, count(DISTINCT brand) AS brands, 3 AS folds, TRUE AS balanced FROM pairs")


def _prepared(s, d):
    """Workspaces: keys that two splits share, negatives that a known pair blocks, and whether a split is empty: all none."""
    out, workspaces = None, sorted(prepared(s, d).items())
    first = workspaces[0][1]  # all workspaces share valid and blocked
    known = first["valid"].where("label = 0").join(first["blocked"], ["pep", "ab"], "left_semi").count()
    for name, w in workspaces:
        leaks = key_overlaps({k: w[k] for k in ("train", "valid", "test")}, _KEY).agg(F.sum("shared").alias("leaks"))
        counts = leaks.select(F.lit(name).alias("corpus"), "leaks", F.lit(known).cast("long").alias("known"), F.lit(w["report"]["train"] > 0).alias("filled"))
        out = counts if out is None else out.unionByName(counts)
    return out


add("G13_prepare_rules", _prepared, "SELECT DISTINCT l_returnflag AS corpus, 0 AS leaks, 0 AS known, TRUE AS filled FROM lineitem")


def _blocked(drawn, positives, keys):
    """Rows drawn per key, and those that are blocked for their peptide exactly or by endpoint group, or have no donor."""
    marked = drawn.withColumn("grp", S.endpoint_group(F.col("ab")))
    exact = positives.select("pep", "ab", F.lit(1).alias("exact")).distinct()
    group = positives.select("pep", S.endpoint_group(F.col("ab")).alias("grp"), F.lit(1).alias("group")).distinct()
    out = marked.join(exact, ["pep", "ab"], "left").join(group, ["pep", "grp"], "left")
    return out.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("exact").isNotNull() | F.col("group").isNotNull()).alias("blocked"), F.count_if(F.col("ab").isNull()).alias("missing"))


add("H1_drawn_rules", lambda s, d: _blocked(_of("H1_drawn_negatives")(s, d), pairs(s, d), ["pep"]), "{P} SELECT pep, count(*) AS n, 0 AS blocked, 0 AS missing FROM (SELECT DISTINCT pep, mhc, ab FROM pairs) GROUP BY pep")
add("H5_epoch_rules", lambda s, d: _blocked(_of("H5_epoch_negatives")(s, d), pairs(s, d), ["pep", "epoch"]), "{P} SELECT pep, epoch::INT AS epoch, count(*) AS n, 0 AS blocked, 0 AS missing FROM (SELECT DISTINCT pep, mhc FROM pairs), range(2) r(epoch) GROUP BY ALL")
_CHAIN = lambda df: df.withColumn("ab", S.last_part(F.col("ab")))
add("H6_redraw_rules", lambda s, d: _blocked(_of("H6_screened_redraws")(s, d), _CHAIN(pairs(s, d)).where("l_linenumber = 1"), ["pep"]), "{P} SELECT pep, count(DISTINCT brand) AS n, 0 AS blocked, 0 AS missing FROM pairs GROUP BY pep")
