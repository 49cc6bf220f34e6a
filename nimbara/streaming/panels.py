"""Structured Streaming forms of the panel aggregation and of flagged periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_panel(df: DataFrame, keys: list[str], ts: str, period: str, late: str, coverage: float = 0.8) -> DataFrame:
    """Tumbling aggregates of a stream under the coverage rule; rows later than ``late`` are ignored."""
    enough = F.count("value") / F.count("*") >= coverage
    w = df.withWatermark(ts, late).groupBy(F.window(ts, period), *keys)
    agg = w.agg(F.count("*").alias("n_rows"), F.when(enough, F.sum("value")).alias("value_sum"), F.when(enough, F.avg("value")).alias("value_mean"), F.when(enough, F.min("value")).alias("value_min"), F.when(enough, F.max("value")).alias("value_max"))
    return agg.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_rows", "value_sum", "value_mean", "value_min", "value_max")


def stream_periods(df: DataFrame, keys: list[str], ts: str, flagged: Column, gap: str, late: str) -> DataFrame:
    """Sessions of flagged rows; a session ends after ``gap`` without one."""
    s = df.filter(flagged).withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys)
    return s.agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end")).drop("session_window")


def read_events(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, append it to a Parquet table and stop; a restart continues from the checkpoint."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
