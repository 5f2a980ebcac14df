"""Records: reasons for exclusion, duplicates, views and filters of pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.schema import MISSING, Caps, require_columns


def capability_reasons(caps: Caps, pep: str = "pep", mhc: str = "hla", ab: str = "ab") -> dict[str, Column]:
    """Named tests for what a model input can't represent; a row may fail several."""
    chains = F.split(F.col(ab), "/", 2)
    alpha, beta = F.length(F.get(chains, F.lit(0))), F.length(F.element_at(chains, -1))
    return {
        "peptide_too_long": F.length(pep) > caps.peptide_max,
        "peptide_too_short": F.length(pep) < caps.peptide_min,
        "peptide_not_amino_acid": ~S.is_standard(F.col(pep)),
        "hla_length_mismatch": F.length(mhc) != caps.mhc_length,
        "alpha_too_long": alpha > caps.chain_max,
        "beta_too_long": beta > caps.chain_max,
        "chain_missing": (alpha == 0) | (beta == 0) | (F.length(ab) - F.length(F.replace(F.col(ab), F.lit("/"), F.lit(""))) != 1),
    }


def with_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    return df.withColumns({k: F.coalesce(v, F.lit(True)) for k, v in reasons.items()})


def split_by_reasons(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept rows as they were, excluded rows with a column per reason)."""
    marked = with_reasons(df, reasons)
    any_of = F.lit(False)
    for name in reasons:
        any_of = any_of | F.col(name)
    return marked.where(~any_of).select(*df.columns), marked.where(any_of)


def reason_counts(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """(reason, rows): one pass, partial sums; reasons overlap."""
    sums = with_reasons(df, reasons).agg(*[F.sum(F.col(k).cast("bigint")).alias(k) for k in reasons])
    return sums.unpivot([], list(reasons), "reason", "rows").select("reason", F.coalesce("rows", F.lit(0)).alias("rows"))


def first_reason(tests: list[tuple[str, Column]]) -> Column:
    """The name of the first test that holds, in order; null if none does."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out


def keep_first(df: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One row per key: the first in order."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def label_conflicts(df: DataFrame, key: list[str], label: Column) -> DataFrame:
    """Keys with more than one label, and how many."""
    return df.groupBy(*key).agg(F.countDistinct(label).alias("labels")).where("labels > 1")


def dedup_evaluation(df: DataFrame, key: list[str], label: str, order: list[str | Column]) -> DataFrame:
    """keep_first, or an error where a key has two labels. Both in one window over the keys, checked as the rows are read."""
    token = S.label_token(F.col(label).cast("string"))
    w = W.partitionBy(*key)
    checked = df.withColumns({"__low": F.min(token).over(w), "__high": F.max(token).over(w), "__rank": F.row_number().over(w.orderBy(*order))})
    clash = F.when(F.col("__low") != F.col("__high"), F.raise_error(F.concat(F.lit("conflicting labels for "), F.concat_ws("|", *[F.col(k).cast("string") for k in key]))).cast("boolean")).otherwise(True)
    return checked.where(clash & (F.col("__rank") == 1)).drop("__low", "__high", "__rank")


def model_frame(df: DataFrame, fallback: str = "split_cdr3_ab") -> DataFrame:
    """ab for the model and cdr3_ab for identity: the identity falls back to another column, then to ab."""
    others = [F.nullif(F.col(c), F.lit("")) for c in ("cdr3_ab", fallback) if c in df.columns]
    return df.withColumn("cdr3_ab", F.coalesce(*others, F.col("ab")))


def identity_frame(df: DataFrame) -> DataFrame:
    """The frame whose ab is the identity, the model's ab kept as model_ab."""
    return model_frame(df).withColumn("model_ab", F.col("ab")).withColumn("ab", F.col("cdr3_ab"))


def single_chain(df: DataFrame, column: str | None = None, pep: str = "pep") -> DataFrame:
    """row_id, peptide, tcr: the chain of a named column, else the last chain of the first paired column present."""
    paired = next((c for c in ("cdr3_ab", "ab_cdr3", "ab") if c in df.columns), None)
    if column:
        require_columns(df, [column])
    elif not paired:
        raise ValueError("no chain column")
    return df.select("row_id", S.norm(F.col(pep)).alias("peptide"), S.norm(F.col(column) if column else S.last_part(F.col(paired))).alias("tcr"))


def valid_compact(pep: str = "peptide", tcr: str = "tcr") -> Column:
    """Both of standard residues, 1 to 34 long."""
    return S.is_standard(F.col(pep)) & S.is_standard(F.col(tcr)) & F.length(pep).between(1, 34) & F.length(tcr).between(1, 34)


def valid_wide(pep: str = "peptide", tcr: str = "tcr") -> Column:
    """Both of A-Z or '*', 1 to 22 and 2 to 20 long."""
    return F.col(pep).rlike(r"^[A-Z*]{1,22}$") & F.col(tcr).rlike(r"^[A-Z*]{2,20}$")


def unsupported(df: DataFrame, valid: Column, policy: str = "exclude") -> tuple[DataFrame, DataFrame]:
    """(valid rows, csv_row of the others: row_id + 2). Policy error: reading the valid rows fails where there are others."""
    if policy not in ("exclude", "error"):
        raise ValueError(f"unknown policy: {policy}")
    bad = df.where(~F.coalesce(valid, F.lit(False))).select((F.col("row_id") + 2).alias("csv_row"))
    ok = F.coalesce(valid, F.lit(False))
    if policy == "error":
        ok = F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("unsupported row "), (F.col("row_id") + 2).cast("string"))).cast("boolean"))
    return df.where(ok), bad


def paired_chains(df: DataFrame, pep: str = "pep", ab: str = "ab", mhc: str = "hla_allele") -> DataFrame:
    """row_id, peptide, alpha, beta, mhc, tcr with the missing sentinel; a row without any chain is an error."""
    chains = F.split(F.col(ab), "/")
    alpha, beta = S.missing_chain(F.get(chains, F.lit(0))), S.missing_chain(F.get(chains, F.lit(1)))
    out = df.select("row_id", S.norm(F.col(pep)).alias("peptide"), alpha.alias("alpha"), beta.alias("beta"), S.prefixed_allele(F.col(mhc)).alias("mhc"))
    both = (F.col("alpha") == MISSING) & (F.col("beta") == MISSING)
    out = out.where(F.when(both, F.raise_error(F.lit("a receptor chain is required")).cast("boolean")).otherwise(True))
    return out.withColumn("tcr", F.concat("alpha", F.lit("/"), "beta", F.lit("|"), "mhc"))


def class_of_mhc(c: Column) -> Column:
    """MHCI, MHCII, or null, from the many spellings of a curated table."""
    return F.when(c.rlike(r"^HLA-[ABC]") | (c == "MHCI"), "MHCI").when(c.rlike(r"^(HLA-D|D)") | (c == "MHCII"), "MHCII")


def curated_by_class(df: DataFrame, cdr3: str, epitope: str, mhc: str) -> DataFrame:
    out = df.where(F.col(epitope).isNotNull() & F.col(cdr3).isNotNull() & ~F.col(cdr3).contains("*"))
    return out.select(F.col(cdr3).alias("cdr3"), F.col(epitope).alias("epitope"), class_of_mhc(F.col(mhc)).alias("mhc_class")).where("mhc_class IS NOT NULL")


def curated_by_score(df: DataFrame, gene: str, epitope: str, score: str, only: str = "TRB", positive: bool = True) -> DataFrame:
    out = df.where((F.col(gene) == only) & F.col(epitope).isNotNull())
    return out.where(F.col(score) > 0) if positive else out


def curated_union(class_i: DataFrame, class_ii: DataFrame, cdr3: str, epitope: str) -> DataFrame:
    """Both classes, junk marks off, residues checked. The residue class admits '|' as the reference results do."""
    both = class_i.withColumn("mhc_class", F.lit("MHCI")).unionByName(class_ii.withColumn("mhc_class", F.lit("MHCII")))
    both = both.where(F.col(cdr3).isNotNull() & ~F.col(cdr3).rlike(r"[#*]") & ~F.coalesce(F.col(epitope).contains("+") | F.col(epitope).contains("beryllium atom"), F.lit(True)))
    out = both.select(F.upper(F.replace(F.col(cdr3), F.lit(" "), F.lit(""))).alias("cdr3"), F.col(epitope).alias("epitope"), "mhc_class")
    return out.where(F.col("cdr3").rlike(r"^[ARNDBCEQZGHILKMFPSTWYV|]+$"))


def curated_class_i(df: DataFrame, longest: int = 17) -> DataFrame:
    return df.where((F.col("mhc_class") == "MHCI") & (F.length("epitope") <= longest)).withColumn("affinity", F.lit(1))


def masked_copy(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumns({f: F.lit(MISSING) for f in fields})


def first_violation(df: DataFrame, valid: Column, order: str = "row_id") -> DataFrame:
    """The least row that isn't valid, or none."""
    return df.where(~F.coalesce(valid, F.lit(False))).agg(F.min(order).alias("first_bad")).where("first_bad IS NOT NULL")


def valid_inference(pep: str = "pep", mhc: str = "hla", ab: str = "ab") -> Column:
    """Standard peptide, MHC of 34 residues or X, and exactly two chains."""
    return S.is_standard(F.col(pep)) & F.col(mhc).rlike(r"^[ACDEFGHIKLMNPQRSTVWYX]{34}$") & (F.size(F.split(F.col(ab), "/")) == 2)


def mhc_beta_contract(mhc_class: str = "mhc_class", beta: str = "mhc_beta_seq") -> Column:
    """Class II has a second MHC chain, class I none."""
    return F.when(F.col(mhc_class) == "II", F.col(beta) != "").otherwise(F.coalesce(F.col(beta), F.lit("")) == "")


def distinct_in_order(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Keys with the place of their first row."""
    return df.groupBy(*key).agg(F.min(order).alias("first_row"))
