"""Files of a workspace: splits, folds, settings, cluster maps, conversions. What exists is never written over."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.sources import readers, writers

# Training defaults by kind of workspace, and file names of splits.
DEFAULTS = {
    "pan": {"batch_size": 32, "patience": 5, "gradient_accumulation_steps": 1},
    "III": {"batch_size": 24, "patience": 4, "gradient_accumulation_steps": 2},
    "IV": {"batch_size": 8, "patience": 4, "gradient_accumulation_steps": 6},
}
SPLIT_FILES = {"train": "train_data_fold{fold}.csv", "valid": "valid_data_fold{fold}.csv", "test": "test_data_fold{fold}.csv", "unseen": "unseen_data.csv"}
_OPTIONAL = {"unseen"}


def read_splits(spark: SparkSession, root: str, columns: list[str], names: tuple[str, ...] = ("train", "valid", "test", "unseen"), fold: int = 0, positives_only: bool = False) -> dict[str, DataFrame]:
    """The named splits; an unseen split may be missing, any other is an error. positives_only: where negatives are drawn anew."""
    out = {}
    for name in names:
        path = f"{root}/{SPLIT_FILES[name].format(fold=fold)}"
        if readers.path_exists(spark, path):
            df = readers.read_split(spark, path, columns)
            out[name] = df.where("label = 1") if positives_only else df
        elif name not in _OPTIONAL:
            raise FileNotFoundError(path)
    return out


def read_fold(spark: SparkSession, root: str, kind: str, fold: int | None = None) -> DataFrame:
    """Training or validation rows of a fold, or any other set as a whole."""
    name = {"train": f"train_fold_{fold}", "val": f"val_fold_{fold}"}.get(kind, f"{kind}_set")
    return readers.read_strings(spark, f"{root}/{name}.csv")


def read_cluster_map(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, member) of a map from names to member lists, one JSON object (key, members) a line; a cluster is the number
    that ends its name, after the last underscore. A name without one is an error."""
    rows = spark.read.schema("key string, members array<string>").json(path)
    number = F.element_at(F.split("key", "_"), -1).cast("int")
    return rows.select(number.alias("cluster"), F.explode("members").alias("member"))


def write_cluster_map(df: DataFrame, path: str, cluster: str, member: str, name: str = "cluster") -> None:
    lists = df.groupBy(F.concat(F.lit(f"{name}_"), F.col(cluster).cast("string")).alias("key")).agg(F.sort_array(F.collect_set(member)).alias("members"))
    lists.write.mode("errorifexists").json(path)


def load_settings(spark: SparkSession, path: str, overrides: dict | None = None, paths: tuple[str, ...] = ()) -> dict:
    """Settings of a JSON file; overrides that aren't None win; settings named in paths are taken relative to the file's folder."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    found = json.loads(text) | {k: v for k, v in (overrides or {}).items() if v is not None}
    if "fraction" in found and not 0 < float(found["fraction"]) < 1:
        raise ValueError("fraction out of range")
    folder = path.rstrip("/").rpartition("/")[0]
    return {k: f"{folder}/{v}" if k in paths and v and not str(v).startswith("/") and "://" not in str(v) else v for k, v in found.items()}


def training_defaults(report: dict, **given) -> dict[str, int]:
    """Defaults for the workspace that report describes; given values that aren't None win."""
    kind = "pan" if report.get("backend") == "pan-esm2" else report.get("level")
    if kind not in DEFAULTS:
        raise ValueError(f"no defaults for a workspace of level {kind}")
    return DEFAULTS[kind] | {k: v for k, v in given.items() if v is not None}


def protocol_gate(reports: DataFrame, version: int, field: str = "split_protocol") -> DataFrame:
    """reports (a JSON text column `report`) with accepted and reason: made under this version, another, or none."""
    found = F.get_json_object("report", f"$.{field}").try_cast("int")
    reason = F.when(found.isNull(), "missing").when(found != version, "legacy")
    return reports.withColumns({"accepted": reason.isNull(), "reason": reason})


def convert(spark: SparkSession, mode: str, source, out: str) -> str:
    """Sources as input files in a place that mustn't exist. identity: records of fold files (a folder, names); domains: records
    (a DataFrame) that a resolver (a function to records and exclusions) splits into those with sequences and the rest."""
    if readers.path_exists(spark, out):
        raise FileExistsError(out)
    if mode == "identity":
        root, names = source
        writers.write_csv(readers.read_folds(spark, root, names), out)
    elif mode == "domains":
        records, resolver = source
        positives, exclusions = resolver(records)
        writers.write_csv(positives, f"{out}/positive_records")
        writers.write_csv(exclusions, f"{out}/exclusions")
        writers.write_report(spark, {"positives": positives.count(), "exclusions": exclusions.count()}, f"{out}/report")
    else:
        raise ValueError(f"unknown mode: {mode}")
    return out


def predict_and_write(df: DataFrame, load: Callable, path: str) -> None:
    """cdr3, epitope, binding of every row by a model that each worker loads once; an existing path is refused."""
    from rowloom.operators.scoring import batch_scorer

    scored = batch_scorer(load, df.select("cdr3", "epitope"), "binding")
    writers.write_csv(scored.select("cdr3", "epitope", "binding"), path)
