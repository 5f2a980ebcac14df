"""Model scoring as plans: linear heads in the JVM, any other model as a vectorized function loaded once per worker."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_score(vector: Column, weights: list[float], bias: float) -> Column:
    """weights . vector + bias."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(float(bias)), lambda s, x: s + x)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def folded(weights: list[float], bias: float, mean: list[float], std: list[float]) -> tuple[list[float], float]:
    """Weights and bias that give on raw features what the old ones give on standardized ones."""
    new = [w / s for w, s in zip(weights, std, strict=True)]
    return new, bias - sum(w * m for w, m in zip(new, mean, strict=True))


def predicted(df: DataFrame, threshold: float, score: str = "score", strict: bool = False) -> DataFrame:
    hit = F.col(score) > threshold if strict else F.col(score) >= threshold
    return df.withColumns({"predicted_label": hit.cast("int"), "threshold": F.lit(float(threshold))})


def scored_distinct(df: DataFrame, key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """score() once per distinct key, joined back: for models that cost more than a join."""
    once = score(df.select(key).where(F.col(key).isNotNull()).distinct())
    return df.join(once, key, "left")


def batch_scorer(load: Callable[[], Callable[[pd.DataFrame], pd.Series]], df: DataFrame, name: str = "score") -> DataFrame:
    """df with a double column from a model that load() makes once per worker task; rows keep their columns and places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield frame.assign(**{name: model(frame)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, `{name}` double")


def run_worker(df: DataFrame, request: dict, load: Callable[[dict], Callable[[pd.DataFrame], pd.Series]], row_id: str = "row_id") -> DataFrame:
    """df with score and threshold from a worker that gets its request as JSON and answers with (row_id, score, threshold).

    The worker is made once per task and sees no other columns than df's. It has to predict every row exactly once: a
    missing or repeated row is an error as the result is read.
    """
    from rowloom.operators.joins import many_to_one

    text = json.dumps(request, sort_keys=True, allow_nan=False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = json.loads(text)
        model = load(asked)
        for frame in frames:
            yield pd.DataFrame({row_id: frame[row_id], "score": model(frame), "threshold": float(asked["threshold"])})

    answer = df.mapInPandas(run, f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, score double, threshold double")
    out = many_to_one(df, answer, [row_id], "left")
    checked = F.when(F.col("score").isNull(), F.raise_error(F.lit("worker left a row out")).cast("double")).otherwise(F.col("score"))
    return out.withColumn("score", checked)


def evaluation_shard(df: DataFrame, rank: int, world: int, index: str = "row_id") -> DataFrame:
    """The rows rank, rank + world, ... of an evaluation set: shards are disjoint, none is padded, together they are all."""
    if not 0 <= rank < world:
        raise ValueError("rank out of range")
    return df.where(F.pmod(F.col(index), F.lit(world)) == rank)


def gathered(shards: list[DataFrame]) -> DataFrame:
    """Predictions of all shards."""
    out = shards[0]
    for shard in shards[1:]:
        out = out.unionByName(shard)
    return out


def score_delta(full: DataFrame, masked: DataFrame, key: str = "row_id", score: str = "score") -> DataFrame:
    """(key, delta): log probability with the context less that without it."""
    return full.select(key, F.col(score).alias("__f")).join(masked.select(key, F.col(score).alias("__m")), key).select(key, (F.col("__f") - F.col("__m")).alias("delta"))


def sequence_log_likelihood(logs: Column, ids: Column, ignore: int) -> Column:
    """Sum of logs at the places whose id isn't ignored."""
    return F.aggregate(F.zip_with(logs, ids, lambda x, i: F.when(i == ignore, 0.0).otherwise(x.cast("double"))), F.lit(0.0), lambda s, x: s + x)


class Adapter(ABC):
    """A baseline as DataFrame transforms."""

    name: str

    @abstractmethod
    def validate(self, df: DataFrame) -> DataFrame:
        """df, or an error if a column is missing."""

    @abstractmethod
    def convert(self, df: DataFrame) -> DataFrame:
        """Model inputs with row_id and without labels."""

    def training_input(self, df: DataFrame) -> DataFrame:
        return self.convert(df).join(df.select("row_id", "label"), "row_id")


ADAPTERS: dict[str, type[Adapter]] = {}


def register(adapter: type[Adapter]) -> type[Adapter]:
    ADAPTERS[adapter.name] = adapter
    return adapter


@register
class SingleChain(Adapter):
    name = "single_chain"

    def validate(self, df: DataFrame) -> DataFrame:
        from rowloom.schema import require_columns

        return require_columns(df, ["row_id", "pep"])

    def convert(self, df: DataFrame) -> DataFrame:
        from rowloom.operators.records import single_chain, unsupported, valid_compact

        return unsupported(single_chain(self.validate(df)), valid_compact())[0]


@register
class PairedChains(Adapter):
    name = "paired_chains"

    def validate(self, df: DataFrame) -> DataFrame:
        from rowloom.schema import require_columns

        return require_columns(df, ["row_id", "pep", "ab", "hla_allele"])

    def convert(self, df: DataFrame) -> DataFrame:
        from rowloom.operators.records import paired_chains

        return paired_chains(self.validate(df))
