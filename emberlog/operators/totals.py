"""Totals of a stored table from the footers of its files: no row is read.

The columnar reader of the second version answers counts and the smallest and largest
of whole numbers from Parquet's own statistics, if rows are grouped by the folder
columns and filtered by nothing else. Which folders count is such a filter. It is
switched on in a session of its own, so other readers keep theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.session import configure
from emberlog.sources.log_table import LogTable, read_logs

FOOTERS = {
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def folder_totals(spark: SparkSession, table: LogTable) -> DataFrame:
    """``(event_date, ingest_batch, rows, first_id, last_id, lowest, highest)``: of each folder
    that readers see the number of rows, the id range, and the severities it has."""
    session = spark.newSession()
    for key, value in FOOTERS.items():
        session.conf.set(key, value)
    configure(session)
    return read_logs(session, table).groupBy("event_date", "ingest_batch").agg(
        F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.min("level").alias("lowest"), F.max("level").alias("highest"),
    )


def day_totals(spark: SparkSession, table: LogTable) -> DataFrame:
    """The same by day: ``(event_date, batches, rows, first_id, last_id, lowest, highest)``."""
    return folder_totals(spark, table).groupBy("event_date").agg(
        F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.min("first_id").alias("first_id"),
        F.max("last_id").alias("last_id"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
    )
