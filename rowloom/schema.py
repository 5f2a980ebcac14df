"""Contracts of the record formats: columns, limits, alphabets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Alphabets, limits and sentinels that results must agree on.
STANDARD = "ACDEFGHIKLMNPQRSTVWY"
MISSING = "<MIS>"
PEPTIDE_LIMITS = {"I": (8, 13), "II": (0, 30)}
MHC_LENGTH = 34
CHAIN_LIMITS = {"I": 28, "II": 28, "III": 28, "IV": 127}
PAN_LIMITS = {"peptide": 30, "tcr": 40, "mhc_alpha": 400, "mhc_beta": 300}
DOMAINS = ("human_I", "human_II", "nonhuman_I", "nonhuman_II")
CLUSTER_EDITS = 2

PAIR_COLUMNS = ("pep", "hla", "hla_allele", "ab", "label")
PAN_COLUMNS = ("peptide", "allele_key", "tcr_alpha_cdr3", "tcr_beta_cdr3", "mhc_alpha_seq", "mhc_beta_seq", "species", "mhc_class", "domain", "label")


@dataclass(frozen=True)
class Caps:
    """Lengths that a model input can represent."""

    peptide_min: int = 8
    peptide_max: int = 13
    mhc_length: int = MHC_LENGTH
    chain_max: int = 28

    @classmethod
    def of(cls, level: str, mhc_class: str = "I") -> Caps:
        low, high = PEPTIDE_LIMITS[mhc_class]
        return cls(low, high, MHC_LENGTH, CHAIN_LIMITS[level])


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def require_columns(df: DataFrame, columns) -> DataFrame:
    """df, or an error that lists the columns it lacks; extra columns stay."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def forbid_columns(df: DataFrame, columns) -> DataFrame:
    """df, or an error if it already has a column that an operator adds."""
    if clash := [c for c in columns if c in df.columns]:
        raise ValueError(f"columns would be overwritten: {', '.join(clash)}")
    return df
