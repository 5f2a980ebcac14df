"""Readers with explicit schemas. Every string column keeps empty strings (never null), as the record contracts ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import sequences as S
from rowloom.operators.components import stored
from rowloom.operators.ranks import running
from rowloom.schema import PAN_COLUMNS, PAN_LIMITS, forbid_columns, require_columns, strings


def blank_nulls(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    line = spark.read.text(path).limit(1).collect()
    return [x.strip().strip('"') for x in line[0][0].lstrip("﻿").split(sep)] if line else []


def read_strings(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """A delimited file as strings; an empty table is an error. Columns come from the header unless given."""
    columns = columns or header_of(spark, path, sep)
    reader = spark.read.schema(strings(*columns)).option("header", header).option("sep", sep).option("encoding", encoding).option("enforceSchema", True)
    out = blank_nulls(reader.csv(path))
    if out.isEmpty():
        raise ValueError(f"no rows in {path}")
    return out


def read_inputs(spark: SparkSession, path: str, required: list[str], added: tuple[str, ...] = ("score", "predicted_label", "threshold")) -> DataFrame:
    """CSV, or TSV by suffix, with the required columns and none that predictions add."""
    return forbid_columns(require_columns(read_strings(spark, path, sep="\t" if path.endswith((".tsv", ".txt")) else ","), required), added)


#: Where a row stands in its file: the file, its split's first byte, and the row's order within the task that reads the split.
_PLACE = ["__file", "__block", "__line"]


def in_place(df: DataFrame) -> DataFrame:
    """df, as a file reader gives it, with the columns of _PLACE. Splits are byte ranges of a file and tasks may read them in any
    order, so the number of a task says nothing."""
    at = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__line": F.monotonically_increasing_id()}
    return df.select("*", *[c.alias(n) for n, c in at.items()])


def with_row_id(df: DataFrame) -> DataFrame:
    """row_id from 0 in file order, files by path. Rows of a split are numbered one after the other as they are read, so a row per split
    tells where it begins and nothing is sorted. Where a split comes twice (a path given twice), running counts over parts of the rows."""
    rows = stored(in_place(df))
    splits = rows.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__line").alias("__first"), F.max("__line").alias("__end")).checkpoint()
    if not splits.where("__end - __first + 1 <> __n").isEmpty():
        return running(rows, [], _PLACE, {"row_id": F.lit(1).cast("long")}).select(*df.columns, "row_id")
    begins = running(splits, [], ["__file", "__block"], {"__before": F.col("__n")}).select("__file", "__block", (F.col("__before") - F.col("__first")).alias("__shift"))
    return rows.join(F.broadcast(begins), ["__file", "__block"]).select(*df.columns, (F.col("__line") + F.col("__shift")).alias("row_id"))  # a row per split


def adapted(df: DataFrame, form: str, level: str, positive: bool = True) -> DataFrame:
    """pep, hla, hla_allele, ab, cdr3_ab, label from a named column layout: canonical, or sources with separate chains."""
    if form == "canonical":
        out = df.withColumnRenamed("hla.allele", "hla_allele") if "hla.allele" in df.columns else df
        out = require_columns(out, ["pep", "hla", "hla_allele", "ab"])
    elif form == "chains":
        cols = {c: F.col(f"`{c}`") for c in df.columns}
        part = "vseq" if level == "IV" else "cdr3"
        ab = F.concat_ws("/", S.norm(cols[f"alpha.{part}"]), S.norm(cols[f"beta.{part}"]))
        ids = F.concat_ws("/", S.norm(cols["alpha.cdr3"]), S.norm(cols["beta.cdr3"]))
        pep = S.training_peptide(cols.get("minimal_epitope", F.lit("")), cols["antigen.epitope"])
        out = df.select(pep.alias("pep"), S.norm(cols["hla.short.seq"]).alias("hla"), S.norm(cols["hla.allele"]).alias("hla_allele"), ab.alias("ab"), ids.alias("cdr3_ab"))
    else:
        raise ValueError(f"unknown format: {form}")
    if positive:
        return out.withColumn("label", F.lit(1))
    return require_columns(out, ["label"]).withColumn("label", F.col("label").cast("int"))


def read_folds(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Positives of all fold files that exist, with an id file:row; missing files are skipped."""
    out = None
    for name in names:
        path = f"{root}/{name}.csv"
        if not path_exists(spark, path):
            continue
        part = with_row_id(read_strings(spark, path)).where(F.trim("label").isin("1", "1.0"))
        part = part.withColumn("observation_id", F.concat(F.lit(f"{name}.csv:"), F.col("row_id").cast("string"))).drop("row_id")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no fold files under {root}")
    return out


def pan_violations(df: DataFrame) -> dict[str, object]:
    """The contract of multi-domain records as named tests."""
    col, inside = F.col, lambda c, n: S.is_standard(F.col(c)) & (F.length(c) <= n)
    class_ii = col("mhc_class") == "II"
    expected = F.concat(F.when(col("species") == "human", "human").otherwise("nonhuman"), F.lit("_"), col("mhc_class"))
    return {
        "species": ~col("species").isin("human", "mouse", "other"),
        "mhc_class": ~col("mhc_class").isin("I", "II"),
        "domain": col("domain") != expected,
        "peptide": ~inside("peptide", PAN_LIMITS["peptide"]),
        "alpha": ~inside("tcr_alpha_cdr3", PAN_LIMITS["tcr"]),
        "beta": ~inside("tcr_beta_cdr3", PAN_LIMITS["tcr"]),
        "mhc_alpha": ~inside("mhc_alpha_seq", PAN_LIMITS["mhc_alpha"]),
        "mhc_beta": F.when(class_ii, ~inside("mhc_beta_seq", PAN_LIMITS["mhc_beta"])).otherwise(col("mhc_beta_seq") != ""),
        "label": ~col("label").cast("string").isin("0", "1"),
    }


def read_pan(df: DataFrame) -> DataFrame:
    """Multi-domain records with their derived columns; a row against the contract fails as it is read."""
    from rowloom.operators.records import first_reason

    df = require_columns(df, PAN_COLUMNS)
    bad = first_reason([(k, F.coalesce(v, F.lit(True))) for k, v in pan_violations(df).items()])
    ok = df.where(F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("record contract: "), bad)).cast("boolean")))
    return ok.withColumns({
        "pep": F.col("peptide"), "hla_allele": F.upper(F.concat_ws("|", "species", "mhc_class", "allele_key")), "ab": F.concat_ws("/", "tcr_alpha_cdr3", "tcr_beta_cdr3"),
        "pair_key": F.concat_ws("|", "domain", "peptide", "allele_key", "tcr_alpha_cdr3", "tcr_beta_cdr3"),
    })


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, record_id, sequence) in no order: the id is the second field of a header with '|', else its first word.

    A header is a line that begins with '>'. Files are read in splits; the headers before a line, counted over its file, say
    which record it belongs to, so a record may reach over splits and have any number of lines. Lines before the first header
    are left out, as are headers without a letter.
    """
    lines = in_place(spark.read.text(path)).withColumn("value", F.regexp_replace("value", r"\r", ""))
    lines = lines.withColumn("__head", F.col("value").startswith(">").cast("long"))
    counted = running(lines, ["__file"], ["__block", "__line"], {"__before": F.col("__head")}).withColumn("__record", F.col("__before") + F.col("__head"))
    body = F.collect_list(F.when(F.col("__head") == 0, F.struct("__block", "__line", "value")))
    records = counted.where("__record > 0").groupBy("__file", "__record").agg(F.trim(F.max(F.when(F.col("__head") == 1, F.substring("value", 2, 1 << 30)))).alias("header"), F.array_sort(body).alias("rest"))
    fields = F.split("header", r"\|")
    ids = F.when(F.size(fields) > 1, F.get(fields, F.lit(1))).otherwise(F.get(F.split("header", r"\s+"), F.lit(0)))
    return records.where("header <> ''").select("header", ids.alias("record_id"), F.upper(F.regexp_replace(F.array_join("rest.value", ""), r"\s", "")).alias("sequence"))


def read_blocked(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(read_strings(spark, path), ["pep", "ab"]).select("pep", "ab").distinct()


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("ab").distinct()


def read_split(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    df = require_columns(read_strings(spark, path), [*columns, "label"])
    return df.select(*columns, F.col("label").cast("int").alias("label"))


def read_triples(spark: SparkSession, path: str, skip_header: bool = True) -> DataFrame:
    """(peptide, tcr, label): tab-separated lines, or comma-separated where there is no tab; '#' lines are comments."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split("value", ","))
    out = lines.select(F.trim(F.get(parts, F.lit(0))).alias("peptide"), F.trim(F.get(parts, F.lit(1))).alias("tcr"), F.trim(F.get(parts, F.lit(2))).alias("label"))
    return out.where(F.lower("peptide") != "peptide") if skip_header else out


def read_lists(spark: SparkSession, tcr_path: str, peptide_path: str) -> DataFrame:
    """Every receptor with every peptide of two one-column files: a product by definition. The shorter list goes to all tasks if it is
    within LIST_BYTES; else Spark pairs partitions."""
    tcrs = spark.read.text(tcr_path).select(F.trim("value").alias("tcr")).where("tcr <> ''")
    peptides = spark.read.text(peptide_path).select(F.trim("value").alias("peptide")).where("peptide <> ''")
    size = lambda df, c: df.agg(F.sum(F.octet_length(c) + 32)).first()[0] or 0
    of_tcrs, of_peptides = size(tcrs, "tcr"), size(peptides, "peptide")
    if min(of_tcrs, of_peptides) > LIST_BYTES:
        return peptides.join(tcrs)
    return peptides.join(F.broadcast(tcrs)) if of_tcrs <= of_peptides else tcrs.join(F.broadcast(peptides)).select("peptide", "tcr")


#: A list up to this many bytes may be broadcast.
LIST_BYTES = 1 << 24


def read_substitution(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """(residue, scores array<double>) of a substitution matrix file; columns and rows named in drop are left out. The first line that
    is no comment names the columns."""
    lines = in_place(spark.read.text(path)).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    first = lines.orderBy(*_PLACE).select("value", *_PLACE).first()
    if first is None:
        return spark.createDataFrame([], "residue string, scores array<double>")
    keep = [i for i, n in enumerate(first["value"].split()) if n not in drop]
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~((F.col("__file") == first["__file"]) & (F.col("__block") == first["__block"]) & (F.col("__line") == first["__line"])))
    out = rows.select(F.get(parts, F.lit(0)).alias("residue"), F.array(*[F.get(parts, F.lit(1 + i)).cast("double") for i in keep]).alias("scores"))
    return out.where(~F.col("residue").isin(*drop)) if drop else out


def read_first_layout(spark: SparkSession, base: str) -> DataFrame:
    """Sequence-level pairs from base.tsv (cdr3, epitope, label) or else base.csv (CDR3, Epitope, Label)."""
    if path_exists(spark, f"{base}.tsv"):
        df = read_strings(spark, f"{base}.tsv", sep="\t")
    else:
        df = read_strings(spark, f"{base}.csv")
    low = {c.lower(): c for c in df.columns}
    require_columns(df.toDF(*[c.lower() for c in df.columns]), ["cdr3", "epitope"])
    label = F.col(low["label"]).cast("int") if "label" in low else F.lit(1)
    return df.select(F.col(low["cdr3"]).alias("cdr3"), F.col(low["epitope"]).alias("epitope"), label.alias("label"))


def read_matrices(spark: SparkSession, summary: DataFrame, folder: str) -> DataFrame:
    """(key, i, j, value) of all matrix files folder/<key>.csv named by summary.key, cell by cell. Header and row names are dropped."""
    cells = F.split("value", ",")
    lines = in_place(spark.read.text(f"{folder}/*.csv")).withColumns({"key": F.regexp_extract("__file", r"([^/]+)\.csv$", 1), "cells": cells})
    numbers = lines.where(F.get("cells", F.lit(1)).try_cast("double").isNotNull())
    rows = running(numbers, ["key"], ["__block", "__line"], {"i": F.lit(1)})
    cells = rows.select("key", "i", F.posexplode(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))).alias("j", "value"))
    return cells.select("key", "i", "j", F.col("value").cast("double").alias("value")).join(summary.select("key").distinct(), "key", "left_semi")


def filtered_training(df: DataFrame, targets: list[str] | str | None = None, binder: int | None = None, exclude: list[str] | None = None, pep: str = "peptide", substring: bool = False) -> DataFrame:
    """Training rows by target peptides, binder label and excluded peptides. substring: a target text holds the peptide somewhere."""
    out = df
    if targets is not None:
        if isinstance(targets, str):
            out = out.where(F.lit(targets).contains(F.col(pep))) if substring else out.where(F.col(pep) == targets)
        else:
            out = out.where(F.col(pep).isin(targets))
    if binder is not None:
        out = out.where(F.col("binder") == binder)
    return out.where(~F.col(pep).isin(exclude)) if exclude else out
