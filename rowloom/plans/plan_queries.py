"""Queries of whole plans and of the remaining helpers (G13, H6, I13, J16, K8, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import metrics as M
from rowloom.functions import sequences as S
from rowloom.operators import negatives, splits
from rowloom.plans.prepare import Config, prepare
from rowloom.plans.registry import add, pairs, scratch, table
from rowloom.schema import Caps, strings
from rowloom.sources import writers

_WIDE = Caps(1, 40, 2, 40)


def corpora(s, d):
    p = pairs(s, d).where("label = 1").withColumns({"pep": F.translate(F.upper(F.replace("pep", F.lit(" "), F.lit(""))), "BJOUXZ", "ACDEFG"), "hla": F.col("mhc"), "hla_allele": F.col("mhc")})
    columns = ["pep", "hla", "hla_allele", "ab", "label"]
    return p.where(F.col("l_returnflag").isin(*"ANR")).select(F.col("l_returnflag").alias("corpus"), *columns), p.where("l_returnflag = 'A' AND l_suppkey = 1").select(*columns)


def prepared(s, d, grouping="pair_stratified"):
    sources, test = corpora(s, d)
    return prepare(sources, test, Config("A", grouping, caps=_WIDE))


def _report(s, d, grouping):
    """Rows of each part of each workspace, and keys that parts share: all 0."""
    from rowloom.operators.joins import key_overlaps

    out = None
    workspaces = sorted(prepared(s, d, grouping).items())
    same = {part: workspaces[0][1][part].count() for part in ("valid", "test", "pool", "blocked")}  # all workspaces share these
    for name, w in workspaces:
        sizes = [(name, part, n) for part, n in (("train", w["report"]["train"]), *same.items())]
        shared = key_overlaps({k: w[k] for k in ("train", "valid", "test")}, ["pep", "mhc", "grp"] if grouping == "pair_stratified" else ["pep"])
        both = s.createDataFrame(sizes, "corpus string, part string, rows long").unionByName(shared.select(F.lit(name).alias("corpus"), F.concat_ws("|", "a", "b").alias("part"), F.col("shared").alias("rows")))
        out = both if out is None else out.unionByName(both)
    return out


add("G13_prepare_pairs", lambda s, d: _report(s, d, "pair_stratified"))
add("G13_prepare_clusters", lambda s, d: _report(s, d, "cluster"))
_CHAIN = lambda df: df.withColumn("ab", S.last_part(F.col("ab")))
add("H6_screened_redraws", lambda s, d: negatives.drawn_negatives(_CHAIN(pairs(s, d)).select("pep", "brand").distinct(), _CHAIN(pairs(s, d)), _CHAIN(pairs(s, d)).where("l_linenumber = 1"), seed=11))
_EMBEDDING = {k: [S.SCALES["hydrophobicity"][k], S.SCALES["helicity"][k]] for k in S.PAN_ORDER}
# The rows once more as text, so that a wrong value in the library shows. O reads as K.
_ROWS = "('A',0.16,1.24),('C',2.50,0.79),('D',-2.49,0.89),('E',-1.50,0.85),('F',5.00,1.26),('G',-3.31,1.15),('H',-4.63,0.97),('I',4.41,1.29),('K',-5.00,0.88),('L',4.76,1.28),('M',3.23,1.22),('N',-3.79,0.94),('P',-4.92,0.57),('Q',-2.76,0.96),('R',-2.77,0.95),('S',-2.85,1.00),('T',-1.08,1.09),('V',3.02,1.27),('W',4.88,1.07),('Y',2.00,1.11),('O',-5.00,0.88)"


def _embedded(s, d):
    rows = table(s, d, "part").select("p_name", F.upper("p_name").alias("x")).distinct().select("p_name", F.explode(S.substituted(S.letters(F.col("x")), _EMBEDDING)).alias("e"))
    return rows.groupBy("p_name").agg(F.round(F.sum(F.get("e", F.lit(0))), 6).alias("first"), F.round(F.sum(F.get("e", F.lit(1))), 6).alias("second"), F.count("e").alias("n"))


add("I13_embedding_rows", _embedded, f"WITH e(k, a, b) AS (VALUES {_ROWS}), c AS (SELECT p_name, unnest(string_split(upper(p_name), '')) AS k FROM (SELECT DISTINCT p_name FROM part)) SELECT p_name, round(sum(a::DOUBLE), 6) AS first, round(sum(b::DOUBLE), 6) AS second, count(a) AS n FROM c LEFT JOIN e USING (k) GROUP BY p_name")
add(
    "J16_per_epitope_auc", lambda s, d: M.ranking(pairs(s, d), ["brand"]).agg(F.round(F.avg("auroc"), 6).alias("auroc"), F.count("auroc").alias("n")),
    "WITH {P} SELECT round(avg(a), 6) AS auroc, count(a) AS n FROM (SELECT brand, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2::DOUBLE) / nullif(sum(label) * (count(*) - sum(label)), 0) AS a FROM (SELECT brand, label, rank() OVER (PARTITION BY brand ORDER BY score) + (count(*) OVER (PARTITION BY brand, score) - 1) / 2::DOUBLE AS r FROM pairs) GROUP BY brand)",
)


def _files(s, d):
    path = scratch(s)
    writers.write_partitioned(pairs(s, d).select("brand", "ab", "score"), path, "brand", "csv")
    return s.read.schema(strings("ab", "score", "brand")).csv(path).groupBy("brand").agg(F.count("*").alias("n"), F.min("ab").alias("first"))


add("K8_file_per_peptide", _files, "{P} SELECT brand, count(*) AS n, min(ab) AS first FROM pairs GROUP BY brand")
add("N8_normalizers", lambda s, d: table(s, d, "supplier").select(S.norm(F.concat(F.lit("  "), F.lower("s_name"), F.lit("\t"))).alias("name")), "SELECT upper(s_name) AS name FROM supplier")
add("N9_binary_metrics", lambda s, d: M.ranking(pairs(s, d), ["kind"]).join(M.classified(pairs(s, d), ["kind"], 0.5), "kind").select("kind", "n", "positives", (F.col("n") - F.col("positives")).alias("negatives"), F.round("f1", 6).alias("f1")), "{P} SELECT kind, count(*) AS n, sum(label) AS positives, count(*) - sum(label) AS negatives, round(2::DOUBLE * count(*) FILTER (WHERE label = 1 AND score >= 0.5) / (sum(label) + count(*) FILTER (WHERE score >= 0.5)), 6) AS f1 FROM pairs GROUP BY kind")
_TENSOR = lambda x, w: F.array_join(F.transform(S.pad_tokens(S.encode(S.letters(x), S.PAN_ORDER, 1, 0), w, F.lit(0)), lambda i: i.cast("string")), ",")
_SQL_TENSOR = lambda x, w: f"array_to_string(list_transform(string_split({x}, ''), lambda c: instr('{S.PAN_ORDER}', c)), ',') || repeat(',0', ({w} - length({x}))::INT)"
add("N10_collated", lambda s, d: pairs(s, d).select(F.upper(F.replace("pep", F.lit(" "), F.lit(""))).alias("p"), "grp").distinct().select("p", "grp", _TENSOR(F.col("p"), 30).alias("peptide_ids"), _TENSOR(F.col("grp"), 12).alias("chain_ids"), F.length("p").cast("long").alias("n")), f"WITH {{P}}, t AS (SELECT DISTINCT upper(replace(pep, ' ', '')) AS p, grp FROM pairs) SELECT p, grp, {_SQL_TENSOR('p', 30)} AS peptide_ids, {_SQL_TENSOR('grp', 12)} AS chain_ids, length(p) AS n FROM t")
add("N11_level_fields", lambda s, d: pairs(s, d).select("pep", "mhc", "ab").distinct().select(*[S.pad_record(F.col("pep"), F.col("mhc"), F.col("ab"), lv, 34, 12)[1].alias(f"level_{lv}") for lv in "12"]).distinct(), "{P} SELECT DISTINCT rpad(pep, 34, 'X') AS level_1, rpad(pep || mhc, 34, 'X') AS level_2 FROM pairs")
add("N14_chain_filters", lambda s, d: pairs(s, d).select(F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("alpha"), F.when(F.col("l_linenumber") < 5, F.col("l_linestatus")).alias("beta")).agg(F.count("alpha").alias("with_alpha"), F.count("beta").alias("with_beta"), F.count_if(F.col("alpha").isNotNull() & F.col("beta").isNotNull()).alias("with_both")), "{P} SELECT count(*) FILTER (WHERE l_linenumber > 2) AS with_alpha, count(*) FILTER (WHERE l_linenumber < 5) AS with_beta, count(*) FILTER (WHERE l_linenumber IN (3, 4)) AS with_both FROM pairs")
add("N21_concatenated", lambda s, d: pairs(s, d).select("pep", "label").unionByName(pairs(s, d).select("pep", F.lit(0).alias("label"))).groupBy("pep").agg(F.count("*").alias("n"), F.sum("label").alias("positives")), "{P} SELECT pep, 2 * count(*) AS n, sum(label) AS positives FROM pairs GROUP BY pep")
add("N23_padded_ids", lambda s, d: table(s, d, "part").select(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("x")).distinct().select("x", F.array_join(F.transform(S.pad_tokens(S.encode(S.letters(F.col("x")), S.COMPACT_ORDER, 0, 20), 34, F.lit(20)), lambda i: i.cast("string")), ",").alias("ids"), F.length("x").cast("long").alias("n")), f"WITH t AS (SELECT DISTINCT upper(replace(p_name, ' ', '')) AS x FROM part) SELECT x, array_to_string(list_transform(string_split(rpad(x, 34, '-'), ''), lambda c: CASE WHEN instr('{S.COMPACT_ORDER}', c) > 0 THEN instr('{S.COMPACT_ORDER}', c) - 1 ELSE 20 END), ',') AS ids, length(x) AS n FROM t")
add("N5_fold_sizes", lambda s, d: splits.hash_folds(pairs(s, d), 5).groupBy("fold").agg(F.count("*").alias("n")), "WITH {P}, k AS (SELECT DISTINCT pep FROM pairs), c AS (SELECT count(*) AS t, greatest(1, round_even(count(*) / 5::DOUBLE, 0))::BIGINT AS e FROM k), f AS (SELECT i AS fold, least(greatest(t - i * e, 0), e) AS n FROM c, range(5) r(i) UNION ALL SELECT NULL, greatest(t - 5 * e, 0) FROM c) SELECT fold::INT AS fold, n FROM f WHERE n > 0")
