"""Queries of the record, sequence and source operators (A, B, I, K, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.operators import records as R
from rowloom.plans.registry import ORDER, add, pairs, scratch, table
from rowloom.schema import STANDARD, Caps
from rowloom.sources import readers, writers

T = lambda c: F.col(c).cast("string")


def _csv(spark, df, header=True, sep=","):
    path = scratch(spark)
    writers.write_csv(df, path, header, sep)
    return path


# --- A: sources -------------------------------------------------------------------------------------------------------
add(
    "A1_string_csv",
    lambda s, d: readers.read_strings(s, _csv(s, table(s, d, "part").select(T("p_partkey").alias("k"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("name"))), ["k", "name"]).groupBy("name").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN p_size > 25 THEN p_name ELSE '' END AS name, count(*) AS n FROM part GROUP BY 1",
)
add(
    "A2_inputs_by_suffix",
    lambda s, d: readers.read_inputs(s, _tsv(s, table(s, d, "nation").select(T("n_nationkey").alias("k"), "n_name")), ["k", "n_name"]),
    "SELECT n_nationkey::VARCHAR AS k, n_name FROM nation",
)


def _tsv(spark, df):
    path = scratch(spark) + ".tsv"
    writers.write_csv(df, path, sep="\t")
    return path


def _chains_layout(s, d):
    p = pairs(s, d)
    cols = {"antigen.epitope": F.col("pep"), "minimal_epitope": F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" m"), F.col("pep"))).otherwise(""), "alpha.cdr3": F.col("l_returnflag"), "beta.cdr3": F.lower("l_linestatus"), "hla.short.seq": F.col("mhc"), "hla.allele": F.col("mhc")}
    return readers.adapted(p.select(*[v.alias(k) for k, v in cols.items()]), "chains", "III").groupBy("pep", "hla_allele", "ab", "cdr3_ab", "label").agg(F.count("*").alias("n"))


add("A3_layout_adapter", _chains_layout, "{P} SELECT upper(CASE WHEN l_linenumber = 1 THEN 'm' || pep ELSE pep END) AS pep, mhc AS hla_allele, l_returnflag || '/' || l_linestatus AS ab, l_returnflag || '/' || l_linestatus AS cdr3_ab, 1 AS label, count(*) AS n FROM pairs GROUP BY ALL")


def _folds(s, d):
    root, nation = scratch(s), table(s, d, "nation")
    for k in (0, 2):
        part = nation.where(F.col("n_nationkey") % 3 == k).orderBy("n_nationkey").select("n_name", F.when(F.col("n_regionkey") > 1, "1").otherwise("0").alias("label"))
        part.coalesce(1).write.option("header", True).csv(f"{root}/fold{k}.csv")
    return readers.read_folds(s, root, ["fold0", "fold1", "fold2"]).select("n_name", "label", "observation_id")


add("A4_fold_union", _folds, "SELECT n_name, '1' AS label, 'fold' || (n_nationkey % 3) || '.csv:' || (row_number() OVER (PARTITION BY n_nationkey % 3 ORDER BY n_nationkey) - 1) AS observation_id FROM nation WHERE n_nationkey % 3 <> 1 QUALIFY n_regionkey > 1")
_DOMAIN = lambda: F.when(F.col("l_returnflag") == "A", "human").when(F.col("l_returnflag") == "N", "mouse").otherwise("other")


def _pan(s, d):
    p = pairs(s, d).select(F.upper(F.translate("pep", " bjouxz", "")).alias("peptide"), F.lit("K1").alias("allele_key"), F.lit("CASS").alias("tcr_alpha_cdr3"), F.lit("CAW").alias("tcr_beta_cdr3"), F.lit("ACD").alias("mhc_alpha_seq"),
                           F.when(F.col("l_linestatus") == "O", "GG").otherwise("").alias("mhc_beta_seq"), _DOMAIN().alias("species"), F.when(F.col("l_linestatus") == "O", "II").otherwise("I").alias("mhc_class"), "label")
    p = p.withColumn("domain", F.concat(F.when(F.col("species") == "human", "human").otherwise("nonhuman"), F.lit("_"), "mhc_class"))
    return readers.read_pan(p).groupBy("domain", "hla_allele", "ab", "peptide").agg(F.count("*").alias("n"))


add(
    "A5_domain_contract", _pan,
    "{P} SELECT CASE WHEN l_returnflag = 'A' THEN 'human' ELSE 'nonhuman' END || CASE WHEN l_linestatus = 'O' THEN '_II' ELSE '_I' END AS domain, upper(CASE l_returnflag WHEN 'A' THEN 'human' WHEN 'N' THEN 'mouse' ELSE 'other' END || '|' || CASE WHEN l_linestatus = 'O' THEN 'II' ELSE 'I' END || '|K1') AS hla_allele, 'CASS/CAW' AS ab, upper(translate(pep, ' bjouxz', '')) AS peptide, count(*) AS n FROM pairs GROUP BY ALL",
)


def _sources(s, d):
    """Slices of one source: rows resolved or excluded with the first reason; both sides from one plan."""
    p = pairs(s, d).withColumn("slice", F.concat_ws("_", "l_returnflag", "l_linestatus"))
    reason = R.first_reason([("no_allele", F.col("mhc") == "S0"), ("short_peptide", F.length("pep") < 9), ("late", F.col("l_linenumber") > 5)])
    return p.withColumn("reason", reason)


_REASON = "CASE WHEN mhc = 'S0' THEN 'no_allele' WHEN length(pep) < 9 THEN 'short_peptide' WHEN l_linenumber > 5 THEN 'late' END"
add("A6_slice_sources", lambda s, d: _sources(s, d).groupBy("slice", "reason").agg(F.count("*").alias("n")), f"{{P}} SELECT l_returnflag || '_' || l_linestatus AS slice, {_REASON} AS reason, count(*) AS n FROM pairs GROUP BY ALL")


def _closure(s, d):
    kept = _sources(s, d)
    dedup = R.keep_first(kept.where("reason IS NULL"), ["slice", "pep", "mhc", "grp"], ORDER)
    counts = kept.groupBy("slice").agg(F.count("*").alias("input"), F.count("reason").alias("excluded"))
    out = dedup.groupBy("slice").agg(F.count("*").alias("kept"))
    return counts.join(out, "slice", "left").select("slice", "input", "excluded", "kept", (F.col("input") - F.col("excluded") - F.col("kept")).alias("duplicates"))


add("A7_source_closure", _closure, f"WITH {{P}}, r AS (SELECT *, l_returnflag || '_' || l_linestatus AS slice, {_REASON} AS reason FROM pairs) SELECT slice, count(*) AS input, count(reason) AS excluded, count(DISTINCT pep || '|' || mhc || '|' || grp) FILTER (WHERE reason IS NULL) AS kept, count(*) - count(reason) - count(DISTINCT pep || '|' || mhc || '|' || grp) FILTER (WHERE reason IS NULL) AS duplicates FROM r GROUP BY slice")


def _fasta(s, d):
    path = scratch(s)
    part = table(s, d, "part").select(F.concat(F.lit(">P|"), T("p_partkey"), F.lit("|x\n"), "p_name", F.lit("\n"), "p_brand").alias("value"))
    part.write.text(path)
    return readers.read_fasta(s, path)


add("A8_fasta", _fasta, "SELECT 'P|' || p_partkey || '|x' AS header, p_partkey::VARCHAR AS record_id, upper(replace(p_name || p_brand, ' ', '')) AS sequence FROM part")
add("A9_blocked_reader", lambda s, d: readers.read_blocked(s, _csv(s, pairs(s, d).select("pep", "ab"))), "{P} SELECT DISTINCT pep, ab FROM pairs")


def _pool(s, d):
    path = scratch(s)
    pairs(s, d).select("ab").distinct().write.parquet(path)
    return readers.read_pool(s, path).agg(F.count("*").alias("donors"), F.min("ab").alias("first"))


add("A10_pool_reader", _pool, "{P} SELECT count(DISTINCT ab) AS donors, min(ab) AS first FROM pairs")
add("A11_split_reader", lambda s, d: readers.read_split(s, _csv(s, pairs(s, d).select("pep", "ab", "mhc", "label")), ["pep"]).groupBy("pep").agg(F.sum("label").alias("positives")), "{P} SELECT pep, sum(label) AS positives FROM pairs GROUP BY pep")


def _triples(s, d):
    path = scratch(s)
    p = pairs(s, d)
    line = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("#"), "pep")).when(F.col("l_linenumber") % 2 == 0, F.concat_ws("\t", "pep", "ab", "label")).otherwise(F.concat_ws(",", "pep", "ab", "label"))
    p.select(line.alias("value")).write.text(path)
    return readers.read_triples(s, path).groupBy("peptide", "label").agg(F.count("*").alias("n"), F.min("tcr").alias("first"))


add("A12_triples", _triples, "{P} SELECT pep AS peptide, label::VARCHAR AS label, count(*) AS n, min(ab) AS first FROM pairs WHERE l_linenumber <> 1 GROUP BY ALL")


def _lists(s, d):
    a, b = scratch(s), scratch(s)
    table(s, d, "nation").select("n_name").write.text(a)
    table(s, d, "region").select("r_name").write.text(b)
    return readers.read_lists(s, a, b)


add("A13_list_product", _lists, "SELECT r_name AS peptide, n_name AS tcr FROM region, nation")


def _lines(s, rows, path):
    """Rows (place, value) as one text file, in order of place."""
    rows.orderBy("place").coalesce(1).select("value").write.text(path)
    return path


def _matrix(s, d):
    """A matrix of line counts by part size and supplier, a letter each, as a file that is read without the last letter."""
    p = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy((F.col("p_size") % 6).alias("r"), (F.col("l_suppkey") % 6).alias("c")).agg(F.count("*").alias("n"))
    counts = p.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("n"))
    cells = [F.coalesce(F.try_element_at("n", F.lit(j).cast("long")), F.lit(0)).cast("string") for j in range(6)]
    rows = counts.select((F.col("r") + 2).alias("place"), F.concat_ws("  ", F.expr("chr(r + 65)"), *cells).alias("value"))
    head = s.range(2).select(F.col("id").alias("place"), F.when(F.col("id") == 0, "# counts").otherwise("   A  B  C  D  E  F").alias("value"))
    return readers.read_substitution(s, _lines(s, head.unionByName(rows), scratch(s)), ("F",))


def _matrix_rows(s, d):
    return _matrix(s, d).select("residue", F.array_join(F.transform("scores", lambda x: x.cast("long").cast("string")), ",").alias("scores"))


add("A14_substitution_matrix", _matrix_rows, "WITH p AS (SELECT p_size % 6 AS r, l_suppkey % 6 AS c, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT chr((q.r + 65)::INT) AS residue, string_agg(coalesce(p.n, 0)::VARCHAR, ',' ORDER BY j) AS scores FROM (SELECT DISTINCT r FROM p WHERE r < 5) q CROSS JOIN range(5) t(j) LEFT JOIN p ON p.r = q.r AND p.c = t.j GROUP BY q.r")


def _layouts(s, d):
    root, p = scratch(s), pairs(s, d)
    writers.write_csv(p.select(F.col("ab").alias("CDR3"), F.col("pep").alias("Epitope"), F.col("label").alias("Label")), f"{root}.csv")
    return readers.read_first_layout(s, root).groupBy("epitope").agg(F.sum("label").alias("positives"), F.count("*").alias("n"))


add("A15_layout_fallback", _layouts, "{P} SELECT pep AS epitope, sum(label) AS positives, count(*) AS n FROM pairs GROUP BY pep")


def _matrices(s, d):
    """For each return flag a matrix of quantities by line number and supplier, a file each, found by a summary of the flags."""
    root, line = scratch(s), table(s, d, "lineitem")
    fs = s._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(s._jsc.hadoopConfiguration())
    cells = line.groupBy("l_returnflag", "l_linenumber").agg(*[F.coalesce(F.sum(F.when(F.col("l_suppkey") % 4 == j, F.col("l_quantity"))), F.lit(0.0)).cast("string").alias(f"c{j}") for j in range(4)])
    path = lambda x: s._jvm.org.apache.hadoop.fs.Path(x)
    fs.mkdirs(path(f"{root}/m"))
    for flag in "ANR":
        rows = cells.where(F.col("l_returnflag") == flag).select(F.col("l_linenumber").cast("long").alias("place"), F.concat_ws(",", F.concat(F.lit("r"), "l_linenumber"), *[f"c{j}" for j in range(4)]).alias("value"))
        _lines(s, s.range(1).select(F.lit(-1).cast("long").alias("place"), F.lit("r,A,B,C,D").alias("value")).unionByName(rows), f"{root}/parts{flag}")
        found = [x.getPath() for x in fs.listStatus(path(f"{root}/parts{flag}")) if x.getPath().getName().startswith("part-")]
        fs.rename(found[0], path(f"{root}/m/{flag}.csv"))
    return readers.read_matrices(s, line.select(F.col("l_returnflag").alias("key")).distinct(), f"{root}/m").select("key", F.col("i").cast("int").alias("i"), "j", "value")


add("A16_matrix_cells", _matrices, "SELECT l_returnflag AS key, (dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_linenumber) - 1)::INT AS i, j::INT AS j, v AS value FROM (SELECT l_returnflag, l_linenumber, j, coalesce(sum(l_quantity) FILTER (WHERE l_suppkey % 4 = j), 0)::DOUBLE AS v FROM lineitem, range(4) t(j) GROUP BY ALL)")
add(
    "A18_latin1",
    lambda s, d: readers.read_strings(s, _latin(s, table(s, d, "nation").select(F.concat("n_name", F.lit("é")).alias("name"))), ["name"], sep="\t", encoding="ISO-8859-1"),
    "SELECT n_name || 'é' AS name FROM nation",
)


def _latin(s, df):
    path = scratch(s)
    df.write.option("header", True).option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)
    return path


_TRAIN = lambda s, d: pairs(s, d).select(F.col("pep").alias("peptide"), F.col("label").alias("binder"), "ab")
add(
    "A19_training_filters",
    lambda s, d: readers.filtered_training(_TRAIN(s, d), binder=1, exclude=[x[0] for x in [("amber arm",)]]).groupBy("peptide").agg(F.count("*").alias("n")),
    "{P} SELECT pep AS peptide, count(*) AS n FROM pairs WHERE label = 1 AND pep <> 'amber arm' GROUP BY pep",
)
add(
    "A20_sequence_list",
    lambda s, d: readers.with_row_id(readers.read_strings(s, _csv(s, table(s, d, "region").orderBy("r_regionkey").select("r_name").coalesce(1)), ["r_name"])).select(T("row_id").alias("id"), F.col("r_name").alias("sequence")),
    "SELECT r_regionkey::VARCHAR AS id, r_name AS sequence FROM region",
)

# --- B: records -------------------------------------------------------------------------------------------------------
add("B1_norm", lambda s, d: table(s, d, "part").select("p_partkey", S.norm(F.concat(F.lit(" \t"), "p_name", F.lit("\n"))).alias("name")), "SELECT p_partkey, upper(p_name) AS name FROM part")
add("B2_training_peptide", lambda s, d: table(s, d, "part").select("p_partkey", S.training_peptide(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" "), F.col("p_name")).alias("pep")), "SELECT p_partkey, upper(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END) AS pep FROM part")
add("B3_endpoint_group", lambda s, d: pairs(s, d).select("ab", "grp").distinct(), "{P} SELECT DISTINCT ab, grp FROM pairs")
add("B4_pair_keys", lambda s, d: pairs(s, d).select(S.pair_key(F.col("pep"), F.col("mhc"), F.col("ab")).alias("key")).distinct(), "{P} SELECT DISTINCT upper(pep) || '|' || mhc || '|' || grp AS key FROM pairs")
add("B5_normalized_keys", lambda s, d: __import__("rowloom.operators.splits", fromlist=["keyed"]).keyed(pairs(s, d).withColumnRenamed("mhc", "hla_allele")), "{P} SELECT DISTINCT upper(pep) AS pep, mhc, grp FROM pairs")
_CAPS = Caps(9, 11, 2, 5)
_CAP_FRAME = lambda s, d: pairs(s, d).withColumns({"pep": F.upper(F.replace(F.col("pep"), F.lit(" "), F.lit(""))), "hla": F.col("mhc")})
_CAP_SQL = """{P}, c AS (SELECT upper(replace(pep, ' ', '')) AS pep, mhc AS hla, ab FROM pairs),
r AS (SELECT length(pep) > 11 AS peptide_too_long, length(pep) < 9 AS peptide_too_short, NOT regexp_full_match(pep, '[ACDEFGHIKLMNPQRSTVWY]+') AS peptide_not_amino_acid, length(hla) <> 2 AS hla_length_mismatch,
  length(split_part(ab, '/', 1)) > 5 AS alpha_too_long, length(split_part(ab, '/', 2)) > 5 AS beta_too_long, FALSE AS chain_missing FROM c)"""
add(
    "B6_capability_reasons", lambda s, d: R.reason_counts(_CAP_FRAME(s, d), R.capability_reasons(_CAPS)),
    "WITH " + _CAP_SQL + " UNPIVOT (SELECT sum(peptide_too_long::INT)::BIGINT AS peptide_too_long, sum(peptide_too_short::INT)::BIGINT AS peptide_too_short, sum(peptide_not_amino_acid::INT)::BIGINT AS peptide_not_amino_acid, sum(hla_length_mismatch::INT)::BIGINT AS hla_length_mismatch, sum(alpha_too_long::INT)::BIGINT AS alpha_too_long, sum(beta_too_long::INT)::BIGINT AS beta_too_long, sum(chain_missing::INT)::BIGINT AS chain_missing FROM r) ON COLUMNS(*) INTO NAME reason VALUE rows",
)
add(
    "B6_capability_split", lambda s, d: R.split_by_reasons(_CAP_FRAME(s, d), R.capability_reasons(_CAPS))[1].groupBy(*R.capability_reasons(_CAPS)).agg(F.count("*").alias("n")),
    "WITH " + _CAP_SQL + " SELECT *, count(*) AS n FROM r WHERE peptide_too_long OR peptide_too_short OR peptide_not_amino_acid OR hla_length_mismatch OR alpha_too_long OR beta_too_long OR chain_missing GROUP BY ALL",
)
add("B7_first_reason", lambda s, d: _sources(s, d).where("reason IS NOT NULL").select("slice", "pep", "mhc", "reason").distinct(), f"{{P}} SELECT DISTINCT l_returnflag || '_' || l_linestatus AS slice, pep, mhc, {_REASON} AS reason FROM pairs WHERE {_REASON} IS NOT NULL")
_RAW_LABEL = lambda: F.when(F.col("l_linenumber") == 1, "1.0").when(F.col("l_linenumber") == 2, " yes ").when(F.col("l_linenumber") == 3, "0.5").when(F.col("l_linenumber") == 4, "0")
add("B8_label_token", lambda s, d: pairs(s, d).select("l_linenumber", S.label_token(_RAW_LABEL()).alias("label")).distinct(), "SELECT DISTINCT l_linenumber, CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN 'YES' WHEN 3 THEN '0.5' WHEN 4 THEN '0' END AS label FROM lineitem JOIN part ON l_partkey = p_partkey")
_KEY = ["pep", "mhc", "grp"]
_FIRST = lambda how: f"row_number() OVER (PARTITION BY {how} ORDER BY {{O}}) = 1"
add("B9_evaluation_dedup", lambda s, d: R.dedup_evaluation(pairs(s, d).where("label = 1"), _KEY, "label", ORDER).select(*_KEY, "l_orderkey", "l_linenumber"), "{P} SELECT pep, mhc, grp, l_orderkey, l_linenumber FROM pairs WHERE label = 1 QUALIFY " + _FIRST("pep, mhc, grp"))
add("B9_label_conflicts", lambda s, d: R.label_conflicts(pairs(s, d), _KEY, F.col("label")), "{P} SELECT pep, mhc, grp, count(DISTINCT label) AS labels FROM pairs GROUP BY ALL HAVING count(DISTINCT label) > 1")
add("B10_keep_first", lambda s, d: R.keep_first(pairs(s, d), ["pep", "mhc"], ORDER).select("pep", "mhc", "ab", "l_orderkey"), "{P} SELECT pep, mhc, ab, l_orderkey FROM pairs QUALIFY " + _FIRST("pep, mhc"))
add(
    "B11_keep_last", lambda s, d: R.keep_first(pairs(s, d), ["pep", "l_returnflag"], [F.desc(c) for c in ORDER]).select("pep", "l_returnflag", "ab", "l_orderkey"),
    "{P} SELECT pep, l_returnflag, ab, l_orderkey FROM pairs QUALIFY row_number() OVER (PARTITION BY pep, l_returnflag ORDER BY " + ", ".join(f"{c} DESC" for c in ORDER) + ") = 1",
)
add("B12_distinct", lambda s, d: pairs(s, d).select("pep", "mhc", "l_returnflag").distinct(), "{P} SELECT DISTINCT pep, mhc, l_returnflag FROM pairs")
add("B13_first_places", lambda s, d: R.distinct_in_order(pairs(s, d), ["pep", "mhc"], "l_orderkey"), "{P} SELECT pep, mhc, min(l_orderkey) AS first_row FROM pairs GROUP BY ALL")
_IDENT = lambda s, d: R.identity_frame(pairs(s, d).withColumn("split_cdr3_ab", F.when(F.col("l_linenumber") == 1, F.col("grp")).otherwise("")))
add("B14_identity_frame", lambda s, d: _IDENT(s, d).select("ab", "model_ab").distinct(), "{P} SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN grp ELSE ab END AS ab, ab AS model_ab FROM pairs")
add("B15_last_chain", lambda s, d: pairs(s, d).select(S.last_part(F.col("ab")).alias("beta")).groupBy("beta").agg(F.count("*").alias("n")), "{P} SELECT split_part(ab, '/', 2) AS beta, count(*) AS n FROM pairs GROUP BY 1")
add("B16_standard_residues", lambda s, d: table(s, d, "part").select("p_name", S.is_standard(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("")))).alias("ok")).distinct(), f"SELECT DISTINCT p_name, regexp_full_match(upper(replace(p_name, ' ', '')), '[{STANDARD}]+') AS ok FROM part")
_INFER = lambda s, d: pairs(s, d).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.upper(F.replace(F.col("pep"), F.lit(" "), F.lit(""))).alias("pep"), F.lit("ACDEFGHIKLMNPQRSTVWYXACDEFGHIKLMNP").alias("hla"), "ab")
add("B17_first_violation", lambda s, d: R.first_violation(_INFER(s, d), R.valid_inference()), f"{{P}} SELECT min(l_orderkey * 10 + l_linenumber) AS first_bad FROM pairs WHERE NOT regexp_full_match(upper(replace(pep, ' ', '')), '[{STANDARD}]+') HAVING count(*) > 0")
add(
    "B18_second_mhc_chain", lambda s, d: pairs(s, d).select(F.when(F.col("l_linestatus") == "O", "II").otherwise("I").alias("mhc_class"), F.when(F.col("l_linenumber") > 3, "GG").otherwise("").alias("mhc_beta_seq")).withColumn("ok", R.mhc_beta_contract()).groupBy("mhc_class", "mhc_beta_seq", "ok").agg(F.count("*").alias("n")),
    "{P}, m AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'II' ELSE 'I' END AS mhc_class, CASE WHEN l_linenumber > 3 THEN 'GG' ELSE '' END AS mhc_beta_seq FROM pairs) SELECT *, (mhc_class = 'II') = (mhc_beta_seq <> '') AS ok, count(*) AS n FROM m GROUP BY ALL",
)
_ROWS = lambda s, d: pairs(s, d).withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
add("B19_single_chain", lambda s, d: R.single_chain(_ROWS(s, d)).groupBy("peptide", "tcr").agg(F.min("row_id").alias("first")), "{P} SELECT upper(pep) AS peptide, split_part(ab, '/', 2) AS tcr, min(l_orderkey * 10 + l_linenumber) AS first FROM pairs GROUP BY ALL")
_ONE = lambda s, d: R.single_chain(_ROWS(s, d).withColumns({"pep": F.replace(F.col("pep"), F.lit(" "), F.lit("")), "letters": F.translate("ab", "0123456789/OB", "ACDEFGHIKLMNP")}), "letters")
_ONE_SQL = "{P}, o AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, upper(replace(pep, ' ', '')) AS peptide, translate(ab, '0123456789/OB', 'ACDEFGHIKLMNP') AS tcr FROM pairs)"
add("B20_validity_masks", lambda s, d: _ONE(s, d).select(R.valid_compact().alias("compact"), R.valid_wide().alias("wide")).groupBy("compact", "wide").agg(F.count("*").alias("n")), "WITH " + _ONE_SQL + f" SELECT regexp_full_match(peptide, '[{STANDARD}]{{1,34}}') AND regexp_full_match(tcr, '[{STANDARD}]{{1,34}}') AS compact, regexp_full_match(peptide, '[A-Z*]{{1,22}}') AND regexp_full_match(tcr, '[A-Z*]{{2,20}}') AS wide, count(*) AS n FROM o GROUP BY ALL")
add("B21_unsupported_rows", lambda s, d: R.unsupported(_ONE(s, d), R.valid_compact())[1], "WITH " + _ONE_SQL + f" SELECT row_id + 2 AS csv_row FROM o WHERE NOT (regexp_full_match(peptide, '[{STANDARD}]{{1,34}}') AND regexp_full_match(tcr, '[{STANDARD}]{{1,34}}'))")
_CHAINS = lambda s, d: R.paired_chains(_ROWS(s, d).withColumns({"hla_allele": F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "A*02:01").otherwise(F.col("mhc")), "ab": F.concat_ws("/", F.when(F.col("l_linenumber") == 3, "na").otherwise(F.col("l_returnflag")), "l_linestatus")}))
add(
    "B22_paired_chains", lambda s, d: _CHAINS(s, d).groupBy("peptide", "alpha", "beta", "mhc", "tcr").agg(F.count("*").alias("n")),
    "{P}, c AS (SELECT upper(pep) AS peptide, CASE WHEN l_linenumber = 3 THEN '<MIS>' ELSE l_returnflag END AS alpha, l_linestatus AS beta, CASE l_linenumber WHEN 1 THEN '<MIS>' WHEN 2 THEN 'HLA-A*02:01' ELSE mhc END AS mhc FROM pairs) SELECT *, alpha || '/' || beta || '|' || mhc AS tcr, count(*) AS n FROM c GROUP BY ALL",
)
_CUR = lambda s, d: pairs(s, d).select(F.when(F.col("l_linenumber") != 7, F.col("ab")).alias("cdr3"), F.when(F.col("l_suppkey") % 5 > 0, F.col("pep")).alias("epitope"), F.when(F.col("l_linestatus") == "O", "HLA-A*02").when(F.col("l_returnflag") == "A", "DRB1").otherwise("x").alias("mhc"))
_CUR_SQL = "{P}, u AS (SELECT CASE WHEN l_linenumber <> 7 THEN ab END AS cdr3, CASE WHEN l_suppkey % 5 > 0 THEN pep END AS epitope, CASE WHEN l_linestatus = 'O' THEN 'MHCI' WHEN l_returnflag = 'A' THEN 'MHCII' END AS mhc_class FROM pairs), k AS (SELECT * FROM u WHERE cdr3 IS NOT NULL AND epitope IS NOT NULL AND mhc_class IS NOT NULL)"
add("B23_curated_by_class", lambda s, d: R.curated_by_class(_CUR(s, d), "cdr3", "epitope", "mhc").groupBy("epitope", "mhc_class").agg(F.count("*").alias("n"), F.min("cdr3").alias("first")), "WITH " + _CUR_SQL + " SELECT epitope, mhc_class, count(*) AS n, min(cdr3) AS first FROM k GROUP BY ALL")
add("B24_curated_by_score", lambda s, d: R.curated_by_score(pairs(s, d), "l_returnflag", "pep", "l_tax", "R").groupBy("pep").agg(F.count("*").alias("n")), "{P} SELECT pep, count(*) AS n FROM pairs WHERE l_returnflag = 'R' AND l_tax > 0 GROUP BY pep")
_UNION = lambda s, d: R.curated_union(*[pairs(s, d).where(F.col("l_linestatus") == x).select(F.when(F.col("l_linenumber") == 1, F.concat("l_returnflag", F.lit(" #"))).otherwise(F.concat(F.lit("c a"), "l_returnflag")).alias("cdr3"), F.when(F.col("l_linenumber") == 2, F.concat("pep", F.lit(" + x"))).otherwise(F.col("pep")).alias("epitope")) for x in "FO"], "cdr3", "epitope")
add("B25_curated_union", lambda s, d: _UNION(s, d).groupBy("cdr3", "epitope", "mhc_class").agg(F.count("*").alias("n")), "{P} SELECT 'CA' || l_returnflag AS cdr3, pep AS epitope, CASE WHEN l_linestatus = 'F' THEN 'MHCI' ELSE 'MHCII' END AS mhc_class, count(*) AS n FROM pairs WHERE l_linenumber > 2 AND l_linestatus IN ('F', 'O') GROUP BY ALL")
add("B26_class_i_short", lambda s, d: R.curated_class_i(R.curated_by_class(_CUR(s, d), "cdr3", "epitope", "mhc"), 11).groupBy("epitope", "affinity").agg(F.count("*").alias("n")), "WITH " + _CUR_SQL + " SELECT epitope, 1 AS affinity, count(*) AS n FROM k WHERE mhc_class = 'MHCI' AND length(epitope) <= 11 GROUP BY ALL")
add("B27_binder_select", lambda s, d: _CHAINS(s, d).where("alpha <> '<MIS>'").groupBy("alpha").agg(F.countDistinct("peptide").alias("peptides")), "{P} SELECT l_returnflag AS alpha, count(DISTINCT upper(pep)) AS peptides FROM pairs WHERE l_linenumber <> 3 GROUP BY 1")
add("B28_masked_copy", lambda s, d: R.masked_copy(_CHAINS(s, d), ["alpha", "mhc"]).select("peptide", "alpha", "beta", "mhc").distinct(), "{P} SELECT DISTINCT upper(pep) AS peptide, '<MIS>' AS alpha, l_linestatus AS beta, '<MIS>' AS mhc FROM pairs")
add("B29_epitope_corpus", lambda s, d: pairs(s, d).select(F.upper(F.replace(F.col("pep"), F.lit(" "), F.lit(""))).alias("epitope")).distinct().where(S.is_standard(F.col("epitope"))), f"{{P}} SELECT DISTINCT upper(replace(pep, ' ', '')) AS epitope FROM pairs WHERE regexp_full_match(upper(replace(pep, ' ', '')), '[{STANDARD}]+')")
add("B30_head", lambda s, d: pairs(s, d).orderBy(*ORDER).limit(100).select("l_orderkey", "l_linenumber", "pep"), "{P} SELECT l_orderkey, l_linenumber, pep FROM pairs ORDER BY {O} LIMIT 100")
_ALLELES = lambda s, d: table(s, d, "supplier").select("s_suppkey", F.concat(F.get(F.array(F.lit("hla/"), F.lit("HLA/HLA-"), F.lit(" "), F.lit("HLA-")), (F.col("s_suppkey") % 4).cast("int")), F.lit("A*0"), T("s_nationkey"), F.lit(":01:02N")).alias("raw"))
add("B31_alleles", lambda s, d: _ALLELES(s, d).select("s_suppkey", S.allele(F.col("raw")).alias("allele"), S.locus(S.allele(F.col("raw"))).alias("locus"), S.two_field(F.col("raw")).alias("two_field")), "SELECT s_suppkey, 'HLA-A*0' || s_nationkey || ':01:02N' AS allele, 'A' AS locus, 'HLA-A*0' || s_nationkey || ':01' AS two_field FROM supplier")
add("B32_composite_key", lambda s, d: table(s, d, "customer").select(S.composite_key(F.col("c_custkey"), F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")), F.col("c_name")).alias("key")), "SELECT c_custkey || '|' || CASE WHEN c_nationkey > 5 THEN c_mktsegment ELSE '' END || '|' || c_name AS key FROM customer")

# --- I: sequence functions --------------------------------------------------------------------------------------------
_NAMES = lambda s, d: table(s, d, "part").select("p_name", F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).alias("x")).distinct()
_N = "n AS (SELECT DISTINCT p_name, upper(replace(p_name, ' ', '')) AS x FROM part)"
_IDS = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
add("I1_levenshtein", lambda s, d: table(s, d, "part").select("p_name", "p_type").distinct().withColumn("d", F.levenshtein("p_name", "p_type").cast("long")), "SELECT DISTINCT p_name, p_type, levenshtein(p_name, p_type) AS d FROM part")
add("I2_bounded_levenshtein", lambda s, d: table(s, d, "part").select("p_name", "p_type").distinct().withColumn("d", S.edits_within(F.col("p_name"), F.col("p_type"), 8).cast("long")), "SELECT DISTINCT p_name, p_type, least(levenshtein(p_name, p_type), 9) AS d FROM part")
add("I3_pad", lambda s, d: _NAMES(s, d).select("p_name", S.pad(F.col("x"), 30).alias("padded")), f"WITH {_N} SELECT p_name, rpad(x, 30, 'X') AS padded FROM n")
add("I4_pad_record", lambda s, d: pairs(s, d).select(*[c.alias(n) for c, n in zip(S.pad_record(F.col("pep"), F.col("mhc"), F.col("ab"), "3", 30, 12), ("receptor", "ligand"), strict=True)]).distinct(), "{P} SELECT DISTINCT rpad(split_part(ab, '/', 1), 12, 'X') || rpad(split_part(ab, '/', 2), 12, 'X') AS receptor, rpad(pep, 30, 'X') || rpad(mhc, 34, 'X') AS ligand FROM pairs")
add("I5_middle_padding", lambda s, d: _NAMES(s, d).select("p_name", F.array_join(S.pad_tokens(S.letters(F.col("x")), 24, F.lit("@"), "mid"), "").alias("padded")), f"WITH {_N} SELECT p_name, substr(x, 1, ((least(length(x), 24) + 1) // 2)::INT) || repeat('@', greatest(0, 24 - length(x))::INT) || right(x, (least(length(x), 24) // 2)::INT) AS padded FROM n")
add("I6_residue_tokens", lambda s, d: table(s, d, "part").select("p_name", F.array_join(S.residue_tokens(F.upper("p_name")), "").alias("tokens")).distinct(), "SELECT DISTINCT p_name, regexp_replace(replace(upper(p_name), ' ', ''), '[^ARNDCQEGHILKMFPSTWYVBZX*]', '*', 'g') AS tokens FROM part")
_ID_SQL = lambda x, order, first, other: f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN instr('{order}', c) > 0 THEN instr('{order}', c) - 1 + {first} ELSE {other} END), ',')"
add("I7_encode", lambda s, d: _NAMES(s, d).select("p_name", _IDS(S.encode(S.letters(F.col("x")), S.PAN_ORDER, 1, 0)).alias("pan"), _IDS(S.encode(S.residue_tokens(F.col("x")), S.BLOSUM_ORDER, 0, 23)).alias("wide")), f"WITH {_N} SELECT p_name, {_ID_SQL('x', S.PAN_ORDER, 1, 0)} AS pan, {_ID_SQL('x', S.BLOSUM_ORDER, 0, 23)} AS wide FROM n")
add("I8_packed", lambda s, d: _NAMES(s, d).where(S.is_standard(F.col("x"))).select("p_name", _IDS(S.encode_packed(F.col("x"), F.reverse("x"), 40, 30)).alias("packed")), f"WITH {_N} SELECT p_name, {_ID_SQL('x', S.PAN_ORDER, 1, 0)} || repeat(',0', (40 - length(x))::INT) || ',' || {_ID_SQL('reverse(x)', S.PAN_ORDER, 1, 0)} || repeat(',0', (30 - length(x))::INT) AS packed FROM n WHERE regexp_full_match(x, '[{STANDARD}]+')")
add("I9_centred", lambda s, d: _NAMES(s, d).select("p_name", F.array_join(S.centred(S.letters(F.col("x")), 20, F.lit("-")), "").alias("centred"), F.array_join(S.epitope_placed(S.letters(F.col("x")), 14, F.lit("-")), "").alias("placed")), f"WITH {_N} SELECT p_name, substr(repeat('-', greatest(0, 10 - length(x) // 2)::INT) || x || repeat('-', 20), 1, 20) AS centred, substr(CASE length(x) WHEN 8 THEN '--' WHEN 9 THEN '-' WHEN 10 THEN '-' ELSE '' END || x || repeat('-', 14), 1, 14) AS placed FROM n")
add("I10_decode", lambda s, d: _NAMES(s, d).select("p_name", S.decode(S.pad_tokens(S.encode(S.residue_tokens(F.col("x")), S.BLOSUM_ORDER, 0, 23), 30, F.lit(24)), S.BLOSUM_ORDER, "@*").alias("text")), f"WITH {_N} SELECT p_name, regexp_replace(x, '[^ARNDCQEGHILKMFPSTWYVBZX]', '', 'g') AS text FROM n")
# The scale once more as text, so that a wrong value in the library shows.
_HELICITY = "('A',1.24),('B',0.92),('C',0.79),('D',0.89),('E',0.85),('F',1.26),('G',1.15),('H',0.97),('I',1.29),('K',0.88),('L',1.28),('M',1.22),('N',0.94),('P',0.57),('Q',0.96),('R',0.95),('S',1.00),('T',1.09),('V',1.27),('W',1.07),('X',1.29),('Y',1.11),('Z',0.91),('*',1.04),('@',0)"
add("I11_properties", lambda s, d: _NAMES(s, d).select("p_name", F.explode(S.properties(S.letters(F.col("x")), "helicity")).alias("v")).groupBy("p_name").agg(F.round(F.sum("v"), 6).alias("total"), F.count("v").alias("n")), f"WITH {_N}, v(k, v) AS (VALUES {_HELICITY}), c AS (SELECT p_name, unnest(string_split(x, '')) AS k FROM n) SELECT p_name, round(sum(v::DOUBLE), 6) AS total, count(v) AS n FROM c LEFT JOIN v USING (k) GROUP BY p_name")
add("I12_substituted", lambda s, d: _NAMES(s, d).select("p_name", F.aggregate(S.substituted(S.letters(F.col("x")), {"A": [1.0, 2.0], "K": [3.0, 4.0], "E": [5.0, 6.0]}), F.lit(0.0), lambda a, v: a + F.coalesce(v[0] * v[1], F.lit(0.0))).alias("s")), f"WITH {_N}, c AS (SELECT p_name, unnest(string_split(x, '')) AS k FROM n) SELECT p_name, sum(CASE k WHEN 'A' THEN 2.0::DOUBLE WHEN 'K' THEN 12 WHEN 'O' THEN 12 WHEN 'E' THEN 30 ELSE 0 END) AS s FROM c GROUP BY p_name")
add("I14_contacts", lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x")).select("vec_id", F.floor(F.col("p") / 8).alias("i"), (F.col("p") % 8).cast("long").alias("j"), (F.abs("x") * 40 < 5).alias("contact")).where("contact"), "SELECT vec_id, (p - 1) // 8 AS i, (p - 1) % 8 AS j, TRUE AS contact FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) WHERE abs(x) * 40 < 5")


def _matrix_embedded(s, d):
    """Sums of the first and last score over a name's letters, each letter as its row of the matrix that A14 reads."""
    rows = {r.residue: r.scores for r in _matrix(s, d).collect()}  # a row per residue
    each = _NAMES(s, d).select("p_name", F.explode(S.substituted(S.letters(F.col("x")), rows)).alias("e"))
    return each.groupBy("p_name").agg(F.sum(F.get("e", F.lit(0))).alias("first"), F.sum(F.get("e", F.lit(4))).alias("last"), F.count("e").alias("n"))


add("I13_matrix_embedding", _matrix_embedded, f"WITH {_N}, p AS (SELECT p_size % 6 AS r, l_suppkey % 6 AS c, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), g AS (SELECT chr((q.r + 65)::INT) AS k, j, coalesce(p.n, 0)::DOUBLE AS v FROM (SELECT DISTINCT r FROM p WHERE r < 5) q CROSS JOIN range(5) t(j) LEFT JOIN p ON p.r = q.r AND p.c = t.j), c AS (SELECT p_name, unnest(string_split(x, '')) AS k FROM n) SELECT p_name, sum(v) FILTER (WHERE j = 0) AS first, sum(v) FILTER (WHERE j = 4) AS last, count(*) FILTER (WHERE j = 0) AS n FROM c LEFT JOIN g USING (k) GROUP BY p_name")
_CODES = lambda s, d: _NAMES(s, d).select("p_name", F.transform(S.letters(F.col("x")), lambda c: F.ascii(c)).alias("ids"))
_SHOWN = lambda m: [F.array_join(F.transform(m[c], lambda x: x.cast("string")), " ").alias(c) for c in ("tokens", "labels")]
_U = "('0x' || substr(md5('42|' || p_name || {}), 1, 13))::BIGINT::DOUBLE / 4503599627370496"
_TOKENS = f"WITH {_N}, c AS (SELECT p_name, unnest(string_split(x, '')) AS ch, generate_subscripts(string_split(x, ''), 1) - 1 AS i, length(x) AS size FROM n), t AS (SELECT p_name, i, ascii(ch) AS id, size FROM c)"
_JOINED = ", m AS ({}) SELECT p_name, string_agg(token::VARCHAR, ' ' ORDER BY i) AS tokens, string_agg(label::VARCHAR, ' ' ORDER BY i) AS labels FROM m GROUP BY p_name"
add("I15_span_masking", lambda s, d: _CODES(s, d).withColumn("m", S.span_masked(F.col("ids"), F.col("p_name"), 42, F.lit(0))).select("p_name", *_SHOWN(F.col("m"))),
    _TOKENS + f", w AS (SELECT *, least(size, 20) AS n, 3 + floor({_U.format("'|length'")} * 3)::INT AS wide FROM t), v AS (SELECT *, floor({_U.format("'|start'")} * (greatest(1, n - wide) + 1))::INT AS start FROM w)"
    + _JOINED.format("SELECT p_name, i, CASE WHEN i >= start AND i < least(start + wide, n) THEN 0 ELSE id END AS token, CASE WHEN i >= start AND i < least(start + wide, n) THEN id ELSE -100 END AS label FROM v"))
add("I15_three_way_masking", lambda s, d: _CODES(s, d).withColumn("m", S.replaced_tokens(F.col("ids"), F.col("p_name"), 42, F.lit(0), 128, 0.15, F.array(F.lit(90)))).select("p_name", *_SHOWN(F.col("m"))),
    _TOKENS + f", w AS (SELECT *, {_U.format("'|' || i || '|chosen'")} < 0.15 AND id <> 90 AS chosen, {_U.format("'|' || i || '|kind'")} AS kind, floor({_U.format("'|' || i || '|id'")} * 128)::INT AS other FROM t)"
    + _JOINED.format("SELECT p_name, i, CASE WHEN NOT chosen THEN id WHEN kind < 0.8 THEN 0 WHEN kind < 0.9 THEN other ELSE id END AS token, CASE WHEN chosen THEN id ELSE -100 END AS label FROM w"))
add("I15_masked_tokens", lambda s, d: _NAMES(s, d).select("p_name", F.array_join(S.masked_tokens(S.letters(F.col("x")), F.col("p_name"), 0.15, 42), "").alias("masked")), f"WITH {_N}, c AS (SELECT p_name, unnest(string_split(x, '')) AS k, generate_subscripts(string_split(x, ''), 1) - 1 AS i FROM n) SELECT p_name, string_agg(CASE WHEN ('0x' || substr(md5('42|' || p_name || '|' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496 < 0.15 THEN '*' ELSE k END, '' ORDER BY i) AS masked FROM c GROUP BY p_name")
add("I17_batch_ids", lambda s, d: _NAMES(s, d).select("p_name", _IDS(S.pad_tokens(S.encode(S.letters(F.col("x")), S.COMPACT_ORDER, 0, 20), 20, F.lit(20))).alias("ids")), f"WITH {_N} SELECT p_name, array_to_string(list_transform(string_split(substr(rpad(x, 20, '-'), 1, 20), ''), lambda c: CASE WHEN instr('{S.COMPACT_ORDER}', c) > 0 THEN instr('{S.COMPACT_ORDER}', c) - 1 ELSE 20 END), ',') AS ids FROM n")

# --- K: sinks ---------------------------------------------------------------------------------------------------------


def _round_trip(s, d):
    path = scratch(s)
    writers.write_partitioned(pairs(s, d).select("kind", "pep", "label"), path, "kind")
    return s.read.parquet(path).groupBy("kind", "pep").agg(F.sum("label").alias("positives"))


add("K3_partitioned", _round_trip, "{P} SELECT kind, pep, sum(label) AS positives FROM pairs GROUP BY ALL")


def _predictions(s, d):
    path = scratch(s)
    rows = _ROWS(s, d).select("row_id", "pep", "score", (F.col("score") >= 0.5).cast("int").alias("predicted_label"))
    writers.write_predictions(rows, path)
    return readers.read_strings(s, path, ["pep", "score", "predicted_label"]).groupBy("pep").agg(F.sum(F.col("predicted_label").cast("int")).alias("predicted"), F.round(F.sum(F.col("score").cast("double")), 6).alias("total"))


add("K6_predictions", _predictions, "{P} SELECT pep, sum((score >= 0.5)::INT) AS predicted, round(sum(score), 6) AS total FROM pairs GROUP BY pep")
add("K9_label_free", lambda s, d: writers.label_free(_ROWS(s, d), ["row_id", "pep", "ab"]).groupBy("pep").agg(F.count("*").alias("n"), F.max("row_id").alias("last")), "{P} SELECT pep, count(*) AS n, max(l_orderkey * 10 + l_linenumber) AS last FROM pairs GROUP BY pep")
add("K7_wide_matrix", lambda s, d: writers.wide_matrix(table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.posexplode("embedding").alias("p", "value")).select("key", F.floor(F.col("p") / 16).alias("i"), F.col("p") % 16, "value").toDF("key", "i", "j", "value"), 4), "SELECT vec_id AS key, b AS i, embedding[b * 16 + 1] AS c0, embedding[b * 16 + 2] AS c1, embedding[b * 16 + 3] AS c2, embedding[b * 16 + 4] AS c3 FROM embeddings, range(4) r(b)")
add("K10_headerless", lambda s, d: readers.read_strings(s, _csv(s, pairs(s, d).groupBy("kind").agg(F.count("*").alias("n")), header=False), ["kind", "n"], header=False), "{P} SELECT kind, count(*)::VARCHAR AS n FROM pairs GROUP BY kind")


def _appended(s, d):
    path = scratch(s)
    for flag in ("A", "N", "R"):
        writers.append_log(pairs(s, d).where(F.col("l_returnflag") == flag).groupBy("l_returnflag").agg(F.count("*").alias("n")), path)
    return s.read.schema("l_returnflag string, n long").json(path)


add("K5_appended_log", _appended, "{P} SELECT l_returnflag, count(*) AS n FROM pairs GROUP BY 1")
