"""Structured Streaming forms of scans and logs. Each gives the rows of the batch form on the same input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str, schema, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def run_waves(source: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """All that is there, wave by wave. A wave's output has its own folder and is overwritten if it is run again, so that a
    restart neither loses nor repeats rows."""

    def wave(rows: DataFrame, number: int) -> None:
        process(rows).write.mode("overwrite").parquet(f"{out}/wave={number}")

    source.writeStream.foreachBatch(wave).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def compacted(log: DataFrame, key: str, ok, order: str) -> DataFrame:
    """Of each key the last success, else the last row."""
    return log.groupBy(key).agg(F.max(F.struct(ok.alias("_ok"), F.col(order).alias("_at"), F.struct(*log.columns).alias("row"))).alias("x")).select("x.row.*")


def rate(events: DataFrame, time: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events a window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
