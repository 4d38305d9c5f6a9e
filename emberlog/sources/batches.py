"""Raw batches: one JSON envelope per request, with its id and arrival time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.schema import RAW_BATCH


def read_batch_files(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """One file per request: the file path is the batch id and its modification
    time the arrival time, so reading it again gives the same batch."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("text").options(wholetext=True, **options).load(path)
    return files.select(
        F.col("_metadata.file_path").alias("batch_id"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.col("value").alias("body"),
    )


def read_batch_table(
    spark: SparkSession, path: str, stream: bool = False, format: str = "parquet", **options
) -> DataFrame:
    """Files of many requests with columns ``batch_id, received_at, body``
    (Parquet, ORC, or JSON lines). ``batch_id`` must be unique per request."""
    reader = spark.readStream if stream else spark.read
    return reader.format(format).schema(RAW_BATCH).options(**options).load(path)


def read_batch_topic(
    spark: SparkSession, servers: str, topic: str, stream: bool = True, **options
) -> DataFrame:
    """A Kafka topic with one request per record; needs the Kafka package on the
    class path. Topic, partition and offset make the batch id."""
    reader = spark.readStream if stream else spark.read
    records = (
        reader.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options})
        .load()
    )
    return records.select(
        F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
        .alias("batch_id"),
        F.col("timestamp").alias("received_at"),
        F.col("value").cast("string").alias("body"),
    )
