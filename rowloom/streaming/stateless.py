"""Row-wise operators on streams, and one windowed count. The reference has no streams; these are extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def apply_stateless(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], form: str = "parquet") -> DataFrame:
    """A stream of the files under path through a row-wise transform."""
    return transform(spark.readStream.schema(schema).format(form).load(path))


def tumbling_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, by, n, total) with a watermark, so state of closed windows goes."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "total")


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there, in micro-batches, exactly once per checkpoint for an idempotent sink."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
