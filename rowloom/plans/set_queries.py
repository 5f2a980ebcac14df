"""Queries of the join, set, aggregate, ranking and metric operators (C, D, E, F, J, L, M, N)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.functions import metrics as M
from rowloom.functions import sequences as S
from rowloom.operators import joins, neighbors, records, scoring, summaries
from rowloom.operators.components import checkpoint_dir
from rowloom.plans.registry import ORDER, add, pairs, scratch, table
from rowloom.sources import writers
from rowloom.streaming import stateless

_KEY = ["pep", "mhc", "grp"]


def _part(flag):
    return lambda s, d: pairs(s, d).where(F.col("l_returnflag") == flag)


_A, _N, _R = _part("A"), _part("N"), _part("R")
# --- C: joins ---------------------------------------------------------------------------------------------------------
add(
    "C1_blocked_pairs", lambda s, d: joins.blocked_pairs(pairs(s, d), pairs(s, d)),
    "{P}, g AS (SELECT DISTINCT pep, grp FROM pairs), p AS (SELECT DISTINCT ab, grp FROM pairs) SELECT pep, ab FROM g JOIN p USING (grp) UNION SELECT pep, ab FROM pairs",
)
add(
    "C2_many_to_one", lambda s, d: joins.many_to_one(table(s, d, "nation"), table(s, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]).select("n_name", "r_name"),
    "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
_R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
add(
    "C3_overlap", lambda s, d: _R6(joins.overlap(_A(s, d), _N(s, d), ["pep", "l_suppkey"]), "pct_a", "pct_b"),
    "WITH {P}, a AS (SELECT DISTINCT pep, l_suppkey FROM pairs WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT pep, l_suppkey FROM pairs WHERE l_returnflag = 'N'), n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (pep, l_suppkey)) AS n_both) SELECT *, round(100.0::DOUBLE * n_both / n_a, 6) AS pct_a, round(100.0::DOUBLE * n_both / n_b, 6) AS pct_b FROM n",
)
add(
    "C4_count_alignment", lambda s, d: pairs(s, d).groupBy("pep").agg(F.count("*").alias("rows")).join(_A(s, d).select(*_KEY).distinct().groupBy("pep").agg(F.count("*").alias("unique_pairs")), "pep", "left"),
    "WITH {P} SELECT * FROM (SELECT pep, count(*) AS rows FROM pairs GROUP BY pep) LEFT JOIN (SELECT pep, count(*) AS unique_pairs FROM (SELECT DISTINCT pep, mhc, grp FROM pairs WHERE l_returnflag = 'A') GROUP BY pep) USING (pep)",
)
add("C5_semi", lambda s, d: joins.in_keys(_A(s, d), _N(s, d), _KEY).groupBy("pep").agg(F.count("*").alias("n")), "{P} SELECT pep, count(*) AS n FROM pairs a WHERE l_returnflag = 'A' AND EXISTS (SELECT 1 FROM pairs b WHERE b.l_returnflag = 'N' AND b.pep = a.pep AND b.mhc = a.mhc AND b.grp = a.grp) GROUP BY pep")
add("C6_anti", lambda s, d: joins.not_in_keys(_A(s, d), _N(s, d), _KEY).groupBy("pep").agg(F.count("*").alias("n")), "{P} SELECT pep, count(*) AS n FROM pairs a WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM pairs b WHERE b.l_returnflag = 'N' AND b.pep = a.pep AND b.mhc = a.mhc AND b.grp = a.grp) GROUP BY pep")
add(
    "C7_admissible_donors", lambda s, d: joins.admissible_donors(_A(s, d), pairs(s, d), joins.blocked_pairs(_A(s, d), pairs(s, d))),
    "WITH {P}, d AS (SELECT DISTINCT ab, grp FROM pairs), g AS (SELECT DISTINCT pep, grp FROM pairs WHERE l_returnflag = 'A'), used AS (SELECT pep, count(DISTINCT ab) AS n FROM g JOIN d USING (grp) GROUP BY pep) SELECT DISTINCT a.pep, (SELECT count(*) FROM d) - coalesce(used.n, 0) AS n_admissible FROM pairs a LEFT JOIN used USING (pep) WHERE l_returnflag = 'A'",
)
add("C8_lookup", lambda s, d: joins.lookup(table(s, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), table(s, d, "nation"), "n_nationkey", ["n_name"]).select("s_suppkey", "n_name"), "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")


def _resolved(s, d):
    exact = table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    fallback = table(s, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return joins.resolve(table(s, d, "customer").select("c_custkey", "c_nationkey"), exact, fallback, F.col("c_nationkey"), F.col("c_nationkey") % 5).select("c_custkey", "sequence", "resolution")


add("C9_resolution", _resolved, "SELECT c_custkey, coalesce(n_name, r_name) AS sequence, CASE WHEN n_name IS NOT NULL THEN 'exact' WHEN r_name IS NOT NULL THEN 'fallback' END AS resolution FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) ON c_nationkey % 5 = r_regionkey")


def _nearest(s, d):
    checkpoint_dir(s)
    names = table(s, d, "part").select("p_name").distinct().withColumn("h", F.md5("p_name"))
    return neighbors.nearest_strings(names.where("h < '4'"), names.where("h >= '4'"), "p_name").withColumn("min_edit_distance", F.col("min_edit_distance").cast("long"))


add("C10_nearest_strings", _nearest, "WITH n AS (SELECT DISTINCT p_name, md5(p_name) AS h FROM part), j AS (SELECT a.p_name, b.p_name AS other, levenshtein(a.p_name, b.p_name) AS d FROM n a, n b WHERE a.h < '4' AND b.h >= '4'), m AS (SELECT p_name, min(d) AS d FROM j GROUP BY p_name) SELECT p_name, d AS min_edit_distance, min(other) AS nearest, count(*) AS nearest_ties FROM j JOIN m USING (p_name, d) GROUP BY p_name, d")
add("C11_bounded_self_join", lambda s, d: neighbors.bounded_self_join(table(s, d, "part"), "p_name", 3).withColumn("d", F.col("d").cast("long")), "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS d FROM n a JOIN n b ON a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= 3")
add("C12_indexed_lookup", lambda s, d: pairs(s, d).select("ab").distinct().withColumn("id", F.md5("ab")).join(pairs(s, d).select("ab", "pep").distinct(), "ab").groupBy("id").agg(F.count("*").alias("n")), "{P} SELECT md5(ab) AS id, count(DISTINCT pep) AS n FROM pairs GROUP BY ab")
add(
    "C13_unobserved_pairs", lambda s, d: joins.unobserved_counts(pairs(s, d), _A(s, d), "kind", "grp"),
    "WITH {P} SELECT kind, count(*) AS n FROM (SELECT DISTINCT kind FROM pairs), (SELECT DISTINCT grp FROM pairs) WHERE (kind, grp) NOT IN (SELECT (kind, grp) FROM pairs WHERE l_returnflag = 'A') GROUP BY kind",
)
_CUST = lambda s, d: table(s, d, "customer").withColumnRenamed("c_custkey", "row_id")
add("C14_correspondence", lambda s, d: joins.mismatches(_CUST(s, d), _CUST(s, d).where("row_id % 10 <> 3").withColumn("c_name", F.when(F.col("row_id") % 7 == 0, "x").otherwise(F.col("c_name"))), ["c_name", "c_nationkey"]), "SELECT count(*) FILTER (WHERE c_custkey % 7 = 0 AND c_custkey % 10 <> 3) AS differ, count(*) FILTER (WHERE c_custkey % 10 = 3) AS unmatched FROM customer")
add("C15_rejoined_results", lambda s, d: joins.rejoin_results(_CUST(s, d).select("row_id", "c_name"), _CUST(s, d).select("row_id", (F.col("c_acctbal") > 0).alias("score")).orderBy(F.desc("row_id")), ["score"]), "SELECT c_custkey AS row_id, c_name, c_acctbal > 0 AS score FROM customer")

# --- D: set operations ------------------------------------------------------------------------------------------------
add("D1_union_all", lambda s, d: _A(s, d).select("pep", F.lit("a").alias("origin")).unionByName(_N(s, d).select("pep", F.lit("n").alias("origin"))).groupBy("pep", "origin").agg(F.count("*").alias("n")), "{P} SELECT pep, lower(l_returnflag) AS origin, count(*) AS n FROM pairs WHERE l_returnflag IN ('A', 'N') GROUP BY ALL")
add("D2_key_overlaps", lambda s, d: joins.key_overlaps({"train": _A(s, d), "valid": _N(s, d), "test": _R(s, d)}, _KEY), "WITH {P}, k AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'valid' ELSE 'test' END AS p, pep, mhc, grp FROM pairs WHERE l_returnflag IN ('A', 'N', 'R')) SELECT x.p AS a, y.p AS b, count(*) AS shared FROM k x JOIN k y USING (pep, mhc, grp) WHERE x.p < y.p GROUP BY ALL")
add("D3_difference", lambda s, d: _A(s, d).select("pep", "mhc", "brand").subtract(_N(s, d).select("pep", "mhc", "brand")), "WITH {P} SELECT pep, mhc, brand FROM pairs WHERE l_returnflag = 'A' EXCEPT SELECT pep, mhc, brand FROM pairs WHERE l_returnflag = 'N'")
add("D4_universe", lambda s, d: _A(s, d).select("pep").union(_R(s, d).select("pep")).distinct(), "WITH {P} SELECT pep FROM pairs WHERE l_returnflag = 'A' UNION SELECT pep FROM pairs WHERE l_returnflag = 'R'")
add("D5_same_sets", lambda s, d: joins.same_sets(_A(s, d), _N(s, d), ["pep", "l_suppkey"]), "WITH {P}, a AS (SELECT DISTINCT pep, l_suppkey FROM pairs WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT pep, l_suppkey FROM pairs WHERE l_returnflag = 'N') SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b")
_FOLD = lambda c, n: F.floor(S.hash_uniform(F.lit("42"), F.col(c)) * n)
_FOLD_SQL_OF = lambda c, n: f"floor(('0x' || substr(md5('42|' || {c}), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * {n})"
add("D6_fold_intersection", lambda s, d: pairs(s, d).where((_FOLD("pep", 5) == 1) & (_FOLD("brand", 3) == 0)).groupBy("pep", "brand").agg(F.count("*").alias("n")), f"{{P}} SELECT pep, brand, count(*) AS n FROM pairs WHERE {_FOLD_SQL_OF('pep', 5)} = 1 AND {_FOLD_SQL_OF('brand', 3)} = 0 GROUP BY ALL")

# --- E: aggregates ----------------------------------------------------------------------------------------------------
add("E1_group_sizes", lambda s, d: pairs(s, d).groupBy("pep").agg(F.count("*").alias("n")), "{P} SELECT pep, count(*) AS n FROM pairs GROUP BY pep")
_SUMS = lambda: {"peptides": F.countDistinct("pep"), "positives": F.sum("label"), "negatives": F.sum(1 - F.col("label")), "rows": F.count("*")}
add("E2_strata", lambda s, d: summaries.strata(pairs(s, d), ["l_returnflag", "kind"], _SUMS()), "{P} SELECT l_returnflag, kind, count(DISTINCT pep) AS peptides, sum(label) AS positives, sum(1 - label) AS negatives, count(*) AS rows FROM pairs GROUP BY GROUPING SETS ((l_returnflag, kind), (l_returnflag))")
add("E3_label_counts", lambda s, d: pairs(s, d).groupBy("kind").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives")), "{P} SELECT kind, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives FROM pairs GROUP BY kind")
add("E4_projection_conflicts", lambda s, d: records.label_conflicts(pairs(s, d), ["pep", "grp"], F.col("label")).agg(F.count("*").alias("conflicts")), "{P} SELECT count(*) AS conflicts FROM (SELECT 1 FROM pairs GROUP BY pep, grp HAVING count(DISTINCT label) > 1)")
add("E5_value_counts", lambda s, d: pairs(s, d).groupBy(F.length("pep").cast("long").alias("len"), "label").agg(F.count("*").alias("n")), "{P} SELECT length(pep) AS len, label, count(*) AS n FROM pairs GROUP BY ALL")
add("E6_reason_histogram", lambda s, d: pairs(s, d).groupBy("l_returnflag", records.first_reason([("large", F.col("l_quantity") > 40), ("taxed", F.col("l_tax") > 0.05)]).alias("reason")).agg(F.count("*").alias("n")), "{P} SELECT l_returnflag, CASE WHEN l_quantity > 40 THEN 'large' WHEN l_tax > 0.05 THEN 'taxed' END AS reason, count(*) AS n FROM pairs GROUP BY ALL")
add("E7_group_sets", lambda s, d: _A(s, d).where("label = 1").select("pep", "grp").distinct().groupBy("pep").agg(F.array_join(F.sort_array(F.collect_set("grp")), ",").alias("groups")), "{P} SELECT pep, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups FROM pairs WHERE l_returnflag = 'A' AND label = 1 GROUP BY pep")
_MODAL = "WITH {P}, c AS (SELECT brand, pep, count(*) AS n, min(l_orderkey) AS first FROM pairs GROUP BY ALL), r AS (SELECT *, max(n) OVER (PARTITION BY brand) AS m FROM c)"
add("E8_modal_value", lambda s, d: summaries.modal_value(pairs(s, d), ["brand"], "pep", "l_orderkey"), _MODAL + " SELECT brand, pep, n, first FROM r WHERE n = m QUALIFY count(*) OVER (PARTITION BY brand) = 1")
add("E8_modal_value_any", lambda s, d: summaries.modal_value(pairs(s, d), ["brand"], "pep", "l_orderkey", False), _MODAL + " SELECT brand, pep, n, first FROM r WHERE n = m QUALIFY row_number() OVER (PARTITION BY brand ORDER BY pep) = 1")
add("E9_coverage", lambda s, d: _resolved(s, d).agg(F.count("*").alias("input"), F.count("sequence").alias("resolved"), F.round(F.count("sequence") / F.count("*"), 6).alias("coverage")), "SELECT count(*) AS input, count(CASE WHEN c_nationkey % 2 = 0 OR c_nationkey % 5 < 4 THEN 1 END) AS resolved, round(count(CASE WHEN c_nationkey % 2 = 0 OR c_nationkey % 5 < 4 THEN 1 END)::DOUBLE / count(*), 6) AS coverage FROM customer")
add("E10_mean_of_groups", lambda s, d: pairs(s, d).groupBy("pep").agg(F.countDistinct("ab").alias("n")).groupBy(F.length("pep").cast("long").alias("len")).agg(F.round(F.avg("n"), 6).alias("mean")), "{P} SELECT length(pep) AS len, round(avg(n), 6) AS mean FROM (SELECT pep, count(DISTINCT ab) AS n FROM pairs GROUP BY pep) GROUP BY 1")
add("E11_description", lambda s, d: pairs(s, d).agg(F.count("*").alias("rows"), F.countDistinct("pep").alias("peptides"), F.countDistinct("ab").alias("receptors"), F.count_if(F.col("score") >= 0.5).alias("high"), F.count_if(F.col("l_returnflag") == "A").alias("a")), "{P} SELECT count(*) AS rows, count(DISTINCT pep) AS peptides, count(DISTINCT ab) AS receptors, count(*) FILTER (WHERE score >= 0.5) AS high, count(*) FILTER (WHERE l_returnflag = 'A') AS a FROM pairs")
add("E12_major_shares", lambda s, d: _R6(summaries.major_shares(pairs(s, d), "pep", 900), "share"), "WITH {P}, c AS (SELECT pep, count(*) AS n FROM pairs GROUP BY pep) SELECT CASE WHEN n >= 900 THEN pep ELSE 'Other' END AS category, sum(n)::BIGINT AS n, round(sum(n)::DOUBLE / (SELECT count(*) FROM pairs), 6) AS share FROM c GROUP BY 1")
_FOLDS = lambda s, d: pairs(s, d).groupBy(F.col("l_linenumber").alias("fold")).agg(F.avg("label").alias("acc"), F.avg("score").alias("auc"))
_FOLD_SQL = "WITH {P}, f AS (SELECT l_linenumber::VARCHAR AS fold, avg(label)::DOUBLE AS acc, avg(score) AS auc FROM pairs GROUP BY 1), m AS (SELECT 'mean' AS fold, avg(acc) AS acc, avg(auc) AS auc FROM f)"
add("E13_fold_table", lambda s, d: _R6(summaries.with_mean_and_std(_FOLDS(s, d), "fold", ["acc", "auc"]), "acc", "auc"), _FOLD_SQL + " SELECT fold, round(acc, 6) AS acc, round(auc, 6) AS auc FROM (FROM f UNION ALL FROM m UNION ALL SELECT 'std', stddev_samp(acc), stddev_samp(auc) FROM f)")
add("E13_fold_table_compat", lambda s, d: _R6(summaries.with_mean_and_std(_FOLDS(s, d), "fold", ["acc", "auc"], True), "acc", "auc"), _FOLD_SQL + " SELECT fold, round(acc, 6) AS acc, round(auc, 6) AS auc FROM (FROM f UNION ALL FROM m UNION ALL SELECT 'std', stddev_samp(acc), stddev_samp(auc) FROM (FROM f UNION ALL FROM m))")
add("E14_nan_mean", lambda s, d: pairs(s, d).select("kind", F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(F.col("score")).alias("x")).groupBy("kind").agg(F.round(F.avg(F.when(~F.isnan("x"), F.col("x"))), 6).alias("mean")), "{P} SELECT kind, round(avg(score) FILTER (WHERE l_linenumber <> 1), 6) AS mean FROM pairs GROUP BY kind")
add("E15_frequency_weights", lambda s, d: _R6(summaries.frequency_weights(pairs(s, d), "pep"), "weight"), "WITH {P}, c AS (SELECT pep, count(*) AS n FROM pairs GROUP BY pep) SELECT pep, n, round(1 / (0.5::DOUBLE * n / (SELECT sum(n) FROM c) + 0.5::DOUBLE / (SELECT count(*) FROM c)) / (SELECT count(*) FROM c), 6) AS weight FROM c")
add("E16_weighted_moments", lambda s, d: _R6(summaries.weighted_moments(table(s, d, "embeddings"), "embedding", F.col("label") + 1), "mean", "std"), "WITH e AS (SELECT label + 1 AS w, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT i, round(sum(w * x) / sum(w), 6) AS mean, round(sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2), 6) AS std FROM e GROUP BY i")
add("E17_min_max", lambda s, d: _R6(summaries.min_max(table(s, d, "supplier"), "s_acctbal").select("s_suppkey", "scaled"), "scaled"), "SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS scaled FROM supplier")
add("E18_rollup", lambda s, d: pairs(s, d).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("label").alias("positives")), "{P} SELECT l_returnflag, l_linestatus, count(*) AS n, sum(label) AS positives FROM pairs GROUP BY ROLLUP (l_returnflag, l_linestatus)")

# --- F: ranking -------------------------------------------------------------------------------------------------------
add("F1_rank_in_group", lambda s, d: pairs(s, d).withColumn("rank", F.row_number().over(W.partitionBy("pep", "l_suppkey").orderBy("score", *ORDER)) - 1).select("pep", "l_suppkey", "l_orderkey", "rank"), "{P} SELECT pep, l_suppkey, l_orderkey, row_number() OVER (PARTITION BY pep, l_suppkey ORDER BY score, {O}) - 1 AS rank FROM pairs")


def _tail(s, d):
    from rowloom.operators.splits import tail_sample

    counts = pairs(s, d).groupBy("pep").agg(F.count("*").alias("n"))
    return tail_sample(counts, 0.8, 1 << 30)


add("F2_frequency_tail", _tail, "WITH {P}, c AS (SELECT pep, count(*) AS n FROM pairs GROUP BY pep) SELECT pep, n FROM c QUALIFY row_number() OVER (ORDER BY n, pep) <= floor(0.8::DOUBLE * count(*) OVER ())")
add("F3_sorted", lambda s, d: pairs(s, d).groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand"), "{P} SELECT brand, count(*) AS n FROM pairs GROUP BY brand ORDER BY n DESC, brand")
add("F4_best_row", lambda s, d: pairs(s, d).groupBy("pep").agg(F.max(F.struct("score", F.col("l_orderkey"), F.col("ab"))).alias("m")).select("pep", F.round("m.score", 6).alias("score"), "m.l_orderkey", "m.ab"), "{P} SELECT pep, round(score, 6) AS score, l_orderkey, ab FROM pairs QUALIFY row_number() OVER (PARTITION BY pep ORDER BY score DESC, l_orderkey DESC, ab DESC) = 1")
add("F6_candidate_order", lambda s, d: _peers(s, d).orderBy(F.desc("peers"), "tie", *_KEY), "WITH {P}, k AS (SELECT pep, mhc, grp, count(DISTINCT l_returnflag) AS peers FROM pairs GROUP BY ALL) SELECT *, md5('42|' || pep || '|' || mhc || '|' || grp) AS tie FROM k ORDER BY peers DESC, tie, pep, mhc, grp")
add("F7_first_offenders", lambda s, d: pairs(s, d).where("l_discount > 0.05").orderBy(*ORDER).limit(5).select("l_orderkey", "l_linenumber", "pep"), "{P} SELECT l_orderkey, l_linenumber, pep FROM pairs WHERE l_discount > 0.05 ORDER BY {O} LIMIT 5")


def _peers(s, d):
    return pairs(s, d).groupBy(*_KEY).agg(F.countDistinct("l_returnflag").alias("peers")).withColumn("tie", S.hash_order(42, *[F.col(c) for c in _KEY]))


# --- J: metrics -------------------------------------------------------------------------------------------------------
_RANK_SQL = """WITH {P}, s AS (SELECT {by}, score, sum(label) AS p, count(*) AS n FROM pairs GROUP BY ALL),
c AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS seen, sum(p) OVER e AS pp, sum(n) OVER e AS nn FROM s WINDOW d AS (PARTITION BY {by} ORDER BY score DESC), e AS (PARTITION BY {by})),
r AS (SELECT *, tp::DOUBLE / seen AS prec, tp::DOUBLE / nullif(pp, 0) AS rec FROM c),
l AS (SELECT *, coalesce(lag(prec) OVER w, 1) AS prec0, coalesce(lag(rec) OVER w, 0) AS rec0 FROM r WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
m AS (SELECT {by}, max(nn)::BIGINT AS n, max(pp)::BIGINT AS positives, sum(p * ((nn - pp) - (seen - tp) + (n - p) / 2::DOUBLE)) / nullif(max(pp) * (max(nn) - max(pp)), 0) AS auroc, sum((rec - rec0) * prec) AS ap, sum((rec - rec0) * (prec + prec0) / 2) AS trap FROM l GROUP BY {by})"""
_RANKED = " SELECT {by}, n, positives, round(auroc, 6) AS auroc, CASE WHEN auroc IS NOT NULL THEN round(ap, 6) END AS average_precision, CASE WHEN auroc IS NOT NULL THEN round(trap, 6) END AS aupr_trapezoid FROM m"
_R3 = ("auroc", "average_precision", "aupr_trapezoid")
for _name, _by in (("J1_J2_J3_ranking", "l_returnflag"), ("J6_per_peptide", "pep"), ("J8_by_domain", "kind")):
    add(_name, lambda s, d, by=_by: _R6(M.ranking(pairs(s, d), [by]), *_R3), (_RANK_SQL + _RANKED).replace("{by}", _by))
add("J6_macro", lambda s, d: _R6(M.macro(pairs(s, d), "pep"), "macro_auroc", "macro_auprc"), (_RANK_SQL + " SELECT round(avg(auroc), 6) AS macro_auroc, round(avg(ap) FILTER (WHERE auroc IS NOT NULL), 6) AS macro_auprc, count(auroc) AS eligible FROM m").replace("{by}", "pep"))
_C = "c AS (SELECT {by}, count(*) FILTER (WHERE h AND label = 1) AS tp, count(*) FILTER (WHERE h AND label = 0) AS fp, count(*) FILTER (WHERE NOT h AND label = 0) AS tn, count(*) FILTER (WHERE NOT h AND label = 1) AS fn FROM h GROUP BY {by})"
_RATES = "tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(2::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"
_R7 = ("accuracy", "sensitivity", "specificity", "precision", "f1", "mcc")
for _name, _by, _op, _strict in (("J4_J5_confusion", "kind", ">=", False), ("J4_confusion_strict", "l_returnflag", ">", True)):
    add(_name, lambda s, d, by=_by, strict=_strict: _R6(M.classified(pairs(s, d), [by], 0.5, strict), *_R7), ("WITH {P}, h AS (SELECT *, score " + _op + " 0.5 AS h FROM pairs), " + _C + " SELECT {by}, " + _RATES + " FROM c").replace("{by}", _by))


def _strata(s, d):
    near = pairs(s, d).withColumn("stratum", F.least(F.length("pep"), F.lit(12)).cast("string"))
    return M.ranking(near.unionByName(near.withColumn("stratum", F.lit("all"))), ["stratum"])


add("J7_by_stratum", lambda s, d: _R6(_strata(s, d), *_R3), (_RANK_SQL.replace("{P}, s AS", "{P}, q AS (SELECT *, least(length(pep), 12)::VARCHAR AS stratum FROM pairs UNION ALL SELECT *, 'all' FROM pairs), s AS").replace("FROM pairs GROUP BY ALL", "FROM q GROUP BY ALL", 1) + _RANKED).replace("{by}", "stratum"))
_CUT_SQL = "g AS (SELECT cut, tp, fp, tn, fn, " + _RATES.split(", ", 4)[4] + " FROM (SELECT cut, sum(p) FILTER (WHERE score {op} cut)::BIGINT AS tp, sum(n - p) FILTER (WHERE score {op} cut)::BIGINT AS fp, sum(n - p) FILTER (WHERE NOT score {op} cut)::BIGINT AS tn, sum(p) FILTER (WHERE NOT score {op} cut)::BIGINT AS fn FROM (SELECT score, sum(label) AS p, count(*) AS n FROM pairs GROUP BY score), cuts GROUP BY cut))"
_CUT_SQL = _CUT_SQL.replace("AS tp, sum", "AS tp, sum").replace("sum(p) FILTER (WHERE score {op} cut)::BIGINT", "coalesce(sum(p) FILTER (WHERE score {op} cut), 0)::BIGINT").replace("sum(n - p) FILTER (WHERE score {op} cut)::BIGINT", "coalesce(sum(n - p) FILTER (WHERE score {op} cut), 0)::BIGINT").replace("sum(n - p) FILTER (WHERE NOT score {op} cut)::BIGINT", "coalesce(sum(n - p) FILTER (WHERE NOT score {op} cut), 0)::BIGINT").replace("sum(p) FILTER (WHERE NOT score {op} cut)::BIGINT", "coalesce(sum(p) FILTER (WHERE NOT score {op} cut), 0)::BIGINT")
_GRID = "WITH {P}, cuts AS (SELECT i::DOUBLE / 200 AS cut FROM range(1, 200) r(i)), "
_PICK = " SELECT round(cut, 6) AS cut, tp, fp, tn, fn, accuracy, sensitivity, specificity, precision, f1, mcc FROM g ORDER BY "
for _name, _strict, _ties, _sql_ties in (("J9_grid_mcc_strict", True, lambda: [F.asc("cut")], "cut"), ("J10_grid_mcc_near_half", False, lambda: [F.abs(F.col("cut") - 0.5), F.asc("cut")], "abs(cut - 0.5), cut")):
    add(_name, lambda s, d, strict=_strict, ties=_ties: _R6(M.best_cut(M.at_cuts(pairs(s, d), M.grid_cuts(s), strict), "mcc", ties()), "cut", *_R7), _GRID + _CUT_SQL.replace("{op}", ">" if _strict else ">=").replace("6) AS mcc", "12) AS mcc") + _PICK.replace("accuracy, sensitivity, specificity, precision, f1, mcc", "accuracy, sensitivity, specificity, precision, f1, round(mcc, 6) AS mcc").replace("FROM g", "FROM g") + f"g.mcc DESC, {_sql_ties} LIMIT 1")
_Q = "WITH {P}, cuts AS (SELECT DISTINCT unnest(quantile_cont(score, [{levels}])) AS cut FROM pairs), "
_L97 = ", ".join(str(round(0.02 + 0.96 * i / 96, 12)) for i in range(97))
add("J11_quantile_f1", lambda s, d: _R6(M.best_cut(M.at_cuts(pairs(s, d), M.quantile_cuts(pairs(s, d), 0.02, 0.98, 97)), "f1", [F.asc("cut")]), "cut", *_R7), _Q.replace("{levels}", _L97) + _CUT_SQL.replace("{op}", ">=").replace("6) AS f1", "12) AS f1") + _PICK.replace("f1, mcc", "round(f1, 6) AS f1, mcc") + "g.f1 DESC, cut LIMIT 1")
_L201 = ", ".join(str(round(i / 200, 12)) for i in range(201))
add("J12_quantile_mcc", lambda s, d: _R6(M.best_cut(M.at_cuts(pairs(s, d), M.quantile_cuts(pairs(s, d), 0.0, 1.0, 201)), "mcc", [F.abs((F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")) - 0.5), F.asc("cut")]), "cut", *_R7), _Q.replace("{levels}", _L201) + _CUT_SQL.replace("{op}", ">=").replace("6) AS mcc", "12) AS mcc") + _PICK.replace("f1, mcc", "f1, round(mcc, 6) AS mcc") + "g.mcc DESC, abs((tp + fp)::DOUBLE / (tp + fp + tn + fn) - 0.5), cut LIMIT 1")
add("J13_single_threshold", lambda s, d: M.single_threshold(pairs(s, d).withColumns({"threshold": F.lit(0.5), "score": F.when(F.col("l_linenumber") == 1, 1.5).otherwise(F.col("score"))})), "{P} SELECT 1 AS thresholds, count(*) FILTER (WHERE l_linenumber = 1) AS bad_rows FROM pairs")
add("J14_predicted_label", lambda s, d: scoring.predicted(pairs(s, d), 0.5).groupBy("pep", "predicted_label", "threshold").agg(F.count("*").alias("n")), "{P} SELECT pep, (score >= 0.5)::INT AS predicted_label, 0.5::DOUBLE AS threshold, count(*) AS n FROM pairs GROUP BY ALL")
add("J15_rounded_record", lambda s, d: M.classified(pairs(s, d).withColumn("score", F.bround("score")), ["l_linestatus"], 1.0).select("l_linestatus", *[F.round(c, 4).alias(c) for c in _R7]), ("WITH {P}, h AS (SELECT *, round_even(score, 0) >= 1 AS h FROM pairs), " + _C + " SELECT l_linestatus, " + _RATES.split(", ", 4)[4].replace(", 6)", ", 4)") + " FROM c").replace("{by}", "l_linestatus"))
_MASK = lambda s, d: pairs(s, d).select("brand", F.col("l_quantity").alias("predicted"), F.col("l_extendedprice").alias("actual"), (F.col("l_linenumber") < 6).alias("mask"))
add("J17_masked_scores", lambda s, d: _R6(summaries.masked_scores(_MASK(s, d), "brand", "predicted", "actual", "mask"), "pearson", "median_ae", "median_ape"), "{P} SELECT brand, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(median(abs(l_quantity - l_extendedprice)), 6) AS median_ae, round(median(abs(l_quantity - l_extendedprice) / abs(l_extendedprice)), 6) AS median_ape FROM pairs WHERE l_linenumber < 6 GROUP BY brand")
add("J18_score_delta", lambda s, d: _R6(scoring.score_delta(table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.ln("o_totalprice").alias("score")), table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.ln(F.col("o_custkey") + 1.0).alias("score"))), "delta"), "SELECT o_orderkey AS row_id, round(ln(o_totalprice) - ln(o_custkey + 1.0::DOUBLE), 6) AS delta FROM orders")
add("J19_log_likelihood", lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(scoring.sequence_log_likelihood(F.col("embedding"), F.transform("embedding", lambda x, i: i % 4), 3), 5).alias("total")), "SELECT vec_id, round(sum(x) FILTER (WHERE (i - 1) % 4 <> 3), 5) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id")
add("J20_perplexity", lambda s, d: pairs(s, d).groupBy("kind").agg(F.round(F.exp(F.sum(F.col("score") * F.col("l_quantity")) / F.sum("l_quantity")), 6).alias("perplexity")), "{P} SELECT kind, round(exp(sum(score * l_quantity) / sum(l_quantity)), 6) AS perplexity FROM pairs GROUP BY kind")
_HIST = lambda s, d: pairs(s, d).groupBy(F.col("kind").alias("run"), F.col("l_linenumber").alias("epoch")).agg(F.round(F.avg("score"), 9).alias("auroc"))
add(
    "J21_early_stop", lambda s, d: summaries.running_best(_HIST(s, d), "auroc", patience=2).select("run", "epoch", F.round("best", 6).alias("best"), "stops"),
    "WITH {P}, h AS (SELECT kind AS run, l_linenumber AS epoch, round(avg(score), 9) AS auroc FROM pairs GROUP BY ALL), b AS (SELECT *, max(auroc) OVER w AS best, coalesce(max(auroc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) AS prev FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)) SELECT run, epoch, round(best, 6) AS best, epoch - max(CASE WHEN auroc > prev THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) >= 2 AS stops FROM b",
)
add("J22_usage_summary", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.round(F.median("value"), 6).alias("median")), "SELECT event_type, round(avg(value), 6) AS mean, max(value) AS most, round(median(value), 6) AS median FROM events GROUP BY event_type")

# --- L: streams, M: models, N: helpers --------------------------------------------------------------------------------


def _streamed(s, d):
    """The stateless path on a stream of part files equals the batch one."""
    root = scratch(s)
    schema = table(s, d, "part").schema
    table(s, d, "part").write.parquet(f"{root}/in")
    stream = stateless.apply_stateless(s, f"{root}/in", schema, lambda df: df.select("p_partkey", S.norm(F.col("p_name")).alias("pep"), S.is_standard(S.norm(F.col("p_brand"))).alias("ok")))
    stateless.run_batches(stream, lambda df, k: df.write.mode("overwrite").parquet(f"{root}/out/{k}"), f"{root}/state").awaitTermination()
    return s.read.option("recursiveFileLookup", True).schema("p_partkey long, pep string, ok boolean").parquet(f"{root}/out")


add("L1_stateless_stream", _streamed, f"SELECT p_partkey, upper(p_name) AS pep, regexp_full_match(upper(p_brand), '[{S.STANDARD}]+') AS ok FROM part")
add("L2_windowed_counts", lambda s, d: _R6(stateless.tumbling_counts(table(s, d, "events")), "total"), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
_W = [((i * 7) % 11 - 5) / 10 for i in range(64)]
_W_SQL = "[" + ", ".join(f"{w}::DOUBLE" for w in _W) + "]"
add("M5_linear_head", lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(scoring.logistic(scoring.linear_score(F.col("embedding"), _W, 0.25)), 6).alias("score")), f"SELECT vec_id, round(1 / (1 + exp(-(0.25::DOUBLE + list_sum(list_transform(generate_series(1, 64), lambda i: embedding[i]::DOUBLE * {_W_SQL}[i]))))), 6) AS score FROM embeddings")
add("M4_scored_distinct", lambda s, d: scoring.scored_distinct(pairs(s, d), "pep", lambda k: k.withColumn("score_of", F.length("pep") * 7 % 5)).groupBy("brand").agg(F.sum("score_of").alias("total")), "{P} SELECT brand, sum(length(pep) * 7 % 5)::BIGINT AS total FROM pairs GROUP BY brand")
add("M3_batch_scorer", lambda s, d: scoring.batch_scorer(lambda: lambda frame: frame["p_size"] * 2.0 + frame["p_name"].str.len(), table(s, d, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", "score"), "SELECT p_partkey, p_size * 2.0::DOUBLE + length(p_name) AS score FROM part")
add("M1_adapter", lambda s, d: scoring.ADAPTERS["single_chain"]().convert(pairs(s, d).withColumns({"row_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "pep": F.replace("pep", F.lit(" "), F.lit("")), "ab": F.translate("ab", "0123456789OB", "ACDEFGHIKLMN")})).groupBy("peptide", "tcr").agg(F.count("*").alias("n")), f"WITH {{P}}, o AS (SELECT upper(replace(pep, ' ', '')) AS peptide, split_part(translate(ab, '0123456789OB', 'ACDEFGHIKLMN'), '/', 2) AS tcr FROM pairs) SELECT peptide, tcr, count(*) AS n FROM o WHERE regexp_full_match(peptide, '[{S.STANDARD}]{{1,34}}') AND regexp_full_match(tcr, '[{S.STANDARD}]{{1,34}}') GROUP BY ALL")
add("N1_self_blocked", lambda s, d: _A(s, d).where("label = 0").join(_A(s, d).where("label = 1").select("pep", "ab").distinct(), ["pep", "ab"], "left_anti").groupBy("pep").agg(F.count("*").alias("n")), "{P} SELECT pep, count(*) AS n FROM pairs a WHERE l_returnflag = 'A' AND label = 0 AND NOT EXISTS (SELECT 1 FROM pairs b WHERE b.l_returnflag = 'A' AND b.label = 1 AND b.pep = a.pep AND b.ab = a.ab) GROUP BY pep")
add("N3_keys_by_peptide", lambda s, d: pairs(s, d).select(*_KEY).distinct().groupBy("pep").agg(F.count("*").alias("keys")), "{P} SELECT pep, count(*) AS keys FROM (SELECT DISTINCT pep, mhc, grp FROM pairs) GROUP BY pep")
add("N4_label_coverage", lambda s, d: pairs(s, d).select("pep").distinct().join(_A(s, d).where("l_suppkey = 3").select("pep").distinct(), "pep", "left_anti"), "WITH {P} SELECT pep FROM pairs EXCEPT SELECT pep FROM pairs WHERE l_returnflag = 'A' AND l_suppkey = 3")
_SPECS = {"A": ["A"], "N": ["N"], "R": ["R"], "A+N": ["A", "N"], "A+R": ["A", "R"], "N+R": ["N", "R"], "all": ["A", "N", "R"]}


def _specs(s, d):
    specs = s.createDataFrame(list(_SPECS.items()), "spec string, flags array<string>")
    per = pairs(s, d).groupBy("l_returnflag", "pep").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(specs), F.array_contains("flags", F.col("l_returnflag"))).groupBy("spec").agg(F.sum("n").alias("rows"), F.countDistinct("pep").alias("peptides"))


add("N6_domain_specs", _specs, "{P} SELECT spec, count(*) AS rows, count(DISTINCT pep) AS peptides FROM pairs JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _SPECS.items()) + ") v(spec, flags) ON list_contains(flags, l_returnflag) GROUP BY spec")
add("N7_dimension", lambda s, d: table(s, d, "part").select("p_brand", S.norm(F.col("p_name")).alias("sequence")).distinct().where(F.col("p_brand").rlike("^[A-Z]")).orderBy("p_brand", "sequence"), "SELECT DISTINCT p_brand, upper(p_name) AS sequence FROM part WHERE regexp_matches(p_brand, '^[A-Z]')")
add("N15_rounded_rows", lambda s, d: pairs(s, d).select("pep", F.bround("score").cast("int").alias("pred")).groupBy("pep", "pred").agg(F.count("*").alias("n")), "{P} SELECT pep, round_even(score, 0)::INT AS pred, count(*) AS n FROM pairs GROUP BY ALL")
add("N16_log_loss", lambda s, d: _R6(M.log_loss(pairs(s, d)), "bce").withColumn("bce", F.round("bce", 3)), "{P} SELECT round(sum(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END), 3) AS bce FROM (SELECT label, least(greatest(score, 1e-7), 1 - 1e-7::DOUBLE) AS p FROM pairs)")
add("N17_guarded_placement", lambda s, d: table(s, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("x")).distinct().where(F.length("x").between(8, 12)).select("x", F.array_join(S.epitope_placed(S.letters(F.col("x")), 12, F.lit("-")), "").alias("placed")), "WITH n AS (SELECT DISTINCT replace(p_name, ' ', '') AS x FROM part) SELECT x, substr(CASE length(x) WHEN 8 THEN '--' WHEN 9 THEN '-' WHEN 10 THEN '-' ELSE '' END || x || repeat('-', 12), 1, 12) AS placed FROM n WHERE length(x) BETWEEN 8 AND 12")
add("N19_failures_as_zero", lambda s, d: summaries.masked_scores(_MASK(s, d).withColumn("predicted", F.when(F.col("brand") < "Brand#2", 1.0).otherwise(F.col("predicted"))), "brand", "predicted", "actual", "mask").select("brand", F.round(F.coalesce("pearson", F.lit(0.0)), 6).alias("pearson")), "{P} SELECT brand, CASE WHEN brand < 'Brand#2' THEN 0 ELSE round(corr(l_quantity, l_extendedprice), 6) END::DOUBLE AS pearson FROM pairs WHERE l_linenumber < 6 GROUP BY brand")
add("N20_masked_mean", lambda s, d: pairs(s, d).groupBy("kind").agg(F.round(F.try_divide(F.sum(F.when(F.col("l_linenumber") < 4, F.col("score"))), F.count_if(F.col("l_linenumber") < 4)), 6).alias("loss")), "{P} SELECT kind, round(sum(score) FILTER (WHERE l_linenumber < 4) / count(*) FILTER (WHERE l_linenumber < 4), 6) AS loss FROM pairs GROUP BY kind")


def _three(s, d, above=300):
    p, by = pairs(s, d), {"alpha": "score", "beta": "l_discount", "peptide": "l_tax"}
    per = p.groupBy("pep").agg(F.count("*").alias("n"))
    out = None
    for name, column in by.items():
        one = M.ranking(p, ["pep"], score=column).join(per.where(F.col("n") > above).select("pep"), "pep", "left_semi").agg(F.lit(name).alias("part"), F.round(F.avg("auroc"), 6).alias("auroc"))
        out = one if out is None else out.unionByName(one)
    return out


_THREE = " UNION ALL ".join(f"SELECT '{n}' AS part, round(avg(a), 6) AS auroc FROM (SELECT pep, sum(CASE WHEN label = 1 THEN r END) AS s, sum(label) AS p, count(*) AS n, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2::DOUBLE) / nullif(sum(label) * (count(*) - sum(label)), 0) AS a FROM (SELECT pep, label, rank() OVER (PARTITION BY pep ORDER BY {c}) + (count(*) OVER (PARTITION BY pep, {c}) - 1) / 2::DOUBLE AS r FROM pairs) GROUP BY pep HAVING count(*) > 300)" for n, c in (("alpha", "score"), ("beta", "l_discount"), ("peptide", "l_tax")))
add("N22_three_aucs", _three, "WITH {P} " + _THREE)
add("N22_every_peptide", lambda s, d: _three(s, d, 0), "WITH {P} " + _THREE.replace(" HAVING count(*) > 300", ""))
add("N24_threshold_transfer", lambda s, d: scoring.predicted(pairs(s, d), 0.5, strict=True).groupBy("brand").agg(F.sum("predicted_label").alias("n")), "{P} SELECT brand, sum((score > 0.5)::INT) AS n FROM pairs GROUP BY brand")
add("N25_whole_batches", lambda s, d: _CUST(s, d).join(F.broadcast(_CUST(s, d).agg((F.count("*") - F.count("*") % 64).alias("whole")))).where("row_id < whole").agg(F.count("*").alias("n")), "SELECT count(*) - count(*) % 64 AS n FROM customer")
add("N26_best_fold", lambda s, d: _FOLDS(s, d).select("fold", F.round((F.col("acc") + F.col("auc")) / 2, 6).alias("mean")).orderBy(F.desc("mean"), "fold").limit(1), "{P} SELECT l_linenumber AS fold, round((avg(label) + avg(score)) / 2, 6) AS mean FROM pairs GROUP BY 1 ORDER BY mean DESC, fold LIMIT 1")
add("N27_json_records", lambda s, d: table(s, d, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("record")), """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS record FROM region""")
