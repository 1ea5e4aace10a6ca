"""Extraction from a stream of token files, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.extract import extract


def token_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def extracted(tokens: DataFrame, out: str, checkpoint: str, **how) -> DataStreamWriter:
    """Hits of each micro-batch, appended; a file holds whole utterances. A batch that is written again replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        extract(batch, **how).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return tokens.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows per window of event time and type, closed once the watermark is past it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
