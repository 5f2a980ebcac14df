"""Query registry: a name, a plan over the driver's tables, and the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import sequences as S
from rowloom.operators.components import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The pair table of the driver's data: a part name with a supplier class and an ordered chain pair, labelled and scored.
PAIRS = """pairs AS (
  SELECT l.*, p_name AS pep, 'S' || (l_suppkey % 7) AS mhc, 'C' || l_suppkey || 'F/' || l_linestatus || l_linenumber || 'W' AS ab,
         rtrim(ltrim('C' || l_suppkey || 'F', 'C'), 'FW') || '/' || rtrim(ltrim(l_linestatus || l_linenumber || 'W', 'C'), 'FW') AS grp,
         (l_quantity > 25)::INT AS label, ((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 97)::DOUBLE / 97 AS score, p_type AS kind, p_brand AS brand
  FROM lineitem l JOIN part ON l_partkey = p_partkey)"""
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDER_SQL = ", ".join(ORDER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("pep"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))
    line = table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    ab = F.concat(F.lit("C"), text("l_suppkey"), F.lit("F/"), "l_linestatus", text("l_linenumber"), F.lit("W"))
    out = line.join(part, line.l_partkey == part.p_partkey).drop("p_partkey")
    return out.withColumns({
        "mhc": F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string")), "ab": ab, "grp": S.endpoint_group(ab), "label": (F.col("l_quantity") > 25).cast("int"),
        "score": ((F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")) % 97).cast("double") / 97,
    })


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"


def add(name: str, plan: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = plan
    if sql:
        SQL[name] = ("WITH " if "{P}" in sql and not sql.lstrip().upper().startswith("WITH") else "") + sql.replace("{P}", PAIRS).replace("{O}", ORDER_SQL)
