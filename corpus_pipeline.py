"""A training corpus from documents: low quality goes, near-duplicates go, secrets are masked, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import mixing, packing, quality, secrets, simhash
from rowloom.llm.common import crc_mod, ensure_checkpoint_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches quality.THRESHOLD, by a model of the labels that op5 learns from.

    Null and empty texts score the labels' share of good ones. Without labels of both kinds all rows stay. Null ids and
    repeated rows are judged by their text like any other; an empty table stays empty.
    """
    model = quality.train_model(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    return quality.keep_good(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one of the smallest id.

    Texts without a word (null, empty) are one component. Rows equal in all columns are one. Null ids are kept only where
    a component has no other. An empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in them replaced by a mark. Null texts stay null; n_chars follows the text where it did before."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes.

    Texts without a word are never taken. A null source is a source. Null ids share one hash, so they are taken or left
    together but for the cut at a word. An empty table stays empty.
    """
    return mixing.mix_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its bin. Null sources conflict with nothing; repeated rows are packed as often as they come."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_each), ("secrets", mask_secrets), ("mix", mix_sources), ("pack", pack_bins)]

#: No SQL has the classifier, the draws or the bin search; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; what lies between goes through the shared checkpoint folder, where a stage's
    rows are removed once the next one's are written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
