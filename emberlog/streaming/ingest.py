"""Continuous ingest: raw batches in, committed rows and answers out.

Spark runs one micro-batch at a time, so one flush is in flight. How much a
micro-batch may hold is set on the source (``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``); what exceeds it waits in the source and nothing is
refused. Late entries are judged by the retention rule and rejected with a
reason; a watermark would drop them without one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators.ingest import ingest
from emberlog.schema import RETENTION_DAYS
from emberlog.sources.log_table import LogTable
from emberlog.sources.table_state import create_text, read_text

# Fixed value: longest wait of a batch before its flush.
FLUSH_INTERVAL = "200 milliseconds"


def stream_token(spark: SparkSession, checkpoint: str) -> str:
    """A name of the stream's own, kept beside its progress.

    A stream that goes on from its progress writes under the same name; one that
    starts anew never writes over rows of an earlier one.
    """
    path = f"{checkpoint.rstrip('/')}/writer"
    create_text(spark, path, uuid.uuid4().hex)
    return read_text(spark, path)


def start_ingest(
    batches: DataFrame,
    table: LogTable,
    checkpoint: str,
    writer: str = "stream",
    flush_interval: str = FLUSH_INTERVAL,
    drain: bool = False,
    retention_days: int = RETENTION_DAYS,
) -> StreamingQuery:
    """Start the stream. With ``drain`` it takes everything the source holds now,
    in micro-batches of the size the source allows, and ends."""

    name = f"{writer}_{stream_token(batches.sparkSession, checkpoint)}"

    def flush(micro: DataFrame, epoch: int) -> None:
        ingest(micro, table, f"{name}-{epoch}", retention_days)

    trigger = {"availableNow": True} if drain else {"processingTime": flush_interval}
    return (
        batches.writeStream.foreachBatch(flush)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stop_when_drained(query: StreamingQuery) -> None:
    """Finish everything that waits, then stop."""
    query.processAllAvailable()
    query.stop()
