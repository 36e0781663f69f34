"""The row-wise operators on streams, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities, tokens


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream with the schema that the files have."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def analysed(stream: DataFrame, column: str) -> DataFrame:
    """Word counts and entities beside each row: stateless, so alike on tables and streams."""
    return stream.withColumn("n_words", F.size(tokens.words(F.col(column)))).withColumn("entities", entities.recognize(F.col(column)))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and key; on a stream, windows close once they are ``late`` behind."""
    stamped = events.withColumn("_at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_at", late)
    return stamped.groupBy(F.window("_at", window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
