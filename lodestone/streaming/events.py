"""The same work over streams: windowed counts with late data, and clean rows as they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import reasons


def read_folder(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed(events: DataFrame, time: str, category: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, category, n, total) per window; works on a table or a stream, whose state is dropped once ``late`` has passed."""
    timed = events.withColumn("_ts", F.col(time).cast("timestamp")).where(F.col("_ts").isNotNull()).withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", width).alias("w"), category).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), category, "n", "total")


def first_seen(events: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Events without later repeats of their key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def quarantine(rows: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Adds reasons, row by row, so a stream can be routed in one query."""
    return rows.withColumn("reasons", reasons(*rules))
