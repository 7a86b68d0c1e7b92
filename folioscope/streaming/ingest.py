"""Page versions as a stream: merge by id, and counts of events in windows of event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import replace_rows


def newest(batch: DataFrame) -> DataFrame:
    """One row per id, that with the highest version."""
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("version")))
    return batch.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_stream(versions: DataFrame, read: Callable[[SparkSession], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces older rows of its ids; ``write`` gets the batch number and must be idempotent."""

    def one(batch: DataFrame, number: int) -> None:
        write(replace_rows(read(batch.sparkSession), newest(batch)), number)

    return versions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value per window and type; rows later than the watermark are left out."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n_events", "total")
