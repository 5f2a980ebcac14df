"""Writers: refuse what exists, keep order where asked, never leak labels."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    df.write.mode("errorifexists").option("header", header).option("sep", sep).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str, form: str = "parquet") -> None:
    """A folder per value. Rows are dealt by value and a hash, so a value of many rows is written by several tasks."""
    salted = df.repartition(F.col(by), F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    salted.write.mode("errorifexists").partitionBy(by).format(form).save(path)


def write_predictions(df: DataFrame, path: str, order: str = "row_id") -> None:
    df.orderBy(order).drop(order).write.mode("errorifexists").option("header", True).csv(path)


def checked_report(value):
    """value, or an error where it holds a number that JSON has no form for."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("report holds a value that is not finite")
    if isinstance(value, dict):
        return {str(k): checked_report(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [checked_report(v) for v in value]
    return value


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """One JSON file in the folder path."""
    text = json.dumps(checked_report(report), sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def label_free(df: DataFrame, columns: list[str]) -> DataFrame:
    """Model inputs: only the named columns, and never a label."""
    if "label" in columns:
        raise ValueError("labels must not reach a model's inputs")
    return df.select(*columns)


def wide_matrix(cells: DataFrame, width: int) -> DataFrame:
    """(key, i, c0, c1, ...) from cells (key, i, j, value): a fixed pivot, so no pass to find the columns."""
    return cells.groupBy("key", "i").agg(*[F.max(F.when(F.col("j") == j, F.col("value"))).alias(f"c{j}") for j in range(width)])


def write_workspace(parts: dict[str, DataFrame], path: str, report: dict, key: list[str]) -> None:
    """The splits, pool and blocked pairs of a workspace, once no two splits share a key."""
    from rowloom.operators.joins import key_overlaps

    splits = {k: v for k, v in parts.items() if k in ("train", "valid", "test")}
    leaks = {f"{r.a}|{r.b}": r.shared for r in key_overlaps(splits, key).collect() if r.shared}
    if leaks:
        raise ValueError(f"splits share keys: {leaks}")
    for name, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    write_report(next(iter(parts.values())).sparkSession, report, f"{path}/report")
