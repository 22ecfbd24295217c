"""Continuous aggregates over streams of samples (ts in epoch ms, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.timeseries import bucket_of, bucketed
from tessera.operators.timeseries import merged_rollup as merge_rollups

ROLLUP = ("count", "sum", "min", "max")


def rollup_stream(samples: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """The rollup of a stream. There is no watermark: late samples reach old buckets, and the state keeps all buckets."""
    return bucketed(samples, width, ROLLUP, by)


def start_rollup(samples: DataFrame, width: int, path: str, by: Sequence[str] = (), checkpoint: str | None = None) -> StreamingQuery:
    """Write the rollup of every batch to the table at `path`, over all data that is there now.

    There is no state: a batch's rollup is a partition of the table (written again if the batch runs again), and read_rollup() adds
    batches up, so late samples reach old buckets.
    """

    def keep(batch: DataFrame, number: int) -> None:
        rollup_stream(batch, width, by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = samples.writeStream.foreachBatch(keep).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint or f"{path}-progress").start()


def read_rollup(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The rollup of all batches so far."""
    return merge_rollups(spark.read.parquet(path).drop("batch"), by)


def compact_rollup(spark: SparkSession, path: str, to: str, by: Sequence[str] = ()) -> None:
    """Write what read_rollup() gives as the only batch of a new table."""
    read_rollup(spark, path, by).write.mode("overwrite").parquet(f"{to}/batch=0")


def run_rollup(spark: SparkSession, samples: DataFrame, width: int, path: str, by: Sequence[str] = ()) -> DataFrame:
    start_rollup(samples, width, path, by).awaitTermination()
    return read_rollup(spark, path, by)


def retained_stream(samples: DataFrame, width: int, lateness: str, by: Sequence[str] = ()) -> DataFrame:
    """Extra: a rollup whose state is bounded by a watermark; samples later than `lateness` are dropped. Adds `window`."""
    timed = samples.withColumn("_time", F.timestamp_millis("ts")).withWatermark("_time", lateness)
    return timed.groupBy(F.window("_time", f"{width} milliseconds"), *by).agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))


def shape(stream: DataFrame, where: str) -> DataFrame:
    """A replica that holds the rows of a filter."""
    return stream.where(where)


def shape_changes(log: DataFrame, where: str, after: int) -> DataFrame:
    """What a subscriber that has seen a change log (lsn, op, columns) up to `after` has to do: put rows of the filter, drop those that left it or were deleted."""
    kept = F.coalesce(F.expr(where), F.lit(False)) & (F.col("op") != "delete")
    return log.where(F.col("lsn") > after).withColumn("op", F.when(kept, "put").otherwise("drop"))


def shape_watermark(log: DataFrame) -> DataFrame:
    """One row: the place in the log up to which a subscriber is then."""
    return log.agg(F.max("lsn").alias("watermark"))


def deduplicated(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key of a replayed log."""
    return stream.dropDuplicates(list(keys))


def bucket_column(width: int):
    return bucket_of(F.col("ts"), width)
