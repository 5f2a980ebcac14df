"""Connected components of an edge table of strings or numbers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_dir(spark) -> None:
    """spark.checkpoint.dir holds. Where none is set, a session of one machine gets a folder; a cluster is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))


#: Whether the shuffle files of a command go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, written once as Parquet into the checkpoint folder: smaller than a checkpoint, read by column and of known size, so that Spark
    sees what may be broadcast. Shuffle files of the write go with its end. by: a column whose values get a folder each."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the least node reachable, for every node with an edge (a, b).

    Each round a node takes the least label of its neighbours and then its label's label (pointer jumping), so the rounds
    grow with the logarithm of the longest chain. Rounds end in a checkpoint and two counters at the driver.
    """
    checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")).checkpoint()
    before = None
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = lower.join(jump, "label").select("node", F.least("label", "next").alias("label")).checkpoint()
        state = labels.agg(F.count("*"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()
        if state == before:
            return labels
        before = state
    raise RuntimeError("components did not settle")
