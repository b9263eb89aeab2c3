"""Counters over a stream of alignment batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and window; rows later than ``late`` are dropped and state is released."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def keep_counters(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Append each batch's counts by keys under its number: a batch that runs again replaces its own. Read the totals with ``totals``."""

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))
