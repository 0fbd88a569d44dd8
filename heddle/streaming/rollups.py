"""Streaming forms of the job roll-ups. An extension: they follow the batch operators with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rollup(samples: DataFrame, time: str, key: str, value: str, size: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Number, mean and largest value per key and tumbling window; rows later than ``late`` are left out. The state is one row per open window and key."""
    w = F.window(F.col(time), size)
    stream = samples.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stream.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), key, "n", "mean", "largest")


def latest_states(updates: DataFrame, time: str, key: str, state: str, late: str = "1 hour") -> DataFrame:
    """Last state per key, for jobs that report as they go."""
    stream = updates.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stream.groupBy(key).agg(F.max_by(state, time).alias(state), F.max(time).alias(time))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there and stop; the checkpoint makes a restart continue exactly once per file sink."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
