"""The stored log table: day folders of Parquet, visible once committed.

Below one root::

    logs/event_date=D/ingest_batch=B/              accepted rows
    minutes/event_date=D/ingest_batch=B/           their counts per minute, service and level
    rejected/received_date=D/ingest_batch=B/       refused entries with their reasons
    acknowledgements/received_date=D/ingest_batch=B/  the answer to every batch
    state/                                         what is committed, and the next id

Ingest batches of one writer come one after the other, so what readers may see is
one number per writer, a filter on folder names. Several writers may work on a
table; each has its own name, and id ranges never overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from emberlog.functions.times import utc_date
from emberlog.schema import ACKNOWLEDGEMENT, MINUTE_COUNT, REJECTED, ROW_COLUMNS, STORED_LOG
from emberlog.sources.table_state import (
    TableState,
    Writer,
    change_state,
    committed_rows,
    folder_name,
    read_state,
    split_name,
    visible_rows,
)

INGEST_BATCH = T.StructField("ingest_batch", T.StringType())

REJECTED_ROW = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    *REJECTED.elementType.fields,
    INGEST_BATCH,
])

RECEIVED_DATE = T.StructField("received_date", T.DateType())

MINUTE_MS = 60_000

DAY_FOLDER = r"(?:event|received)_date=(\d{4}-\d{2}-\d{2})"


@dataclass(frozen=True)
class LogTable:
    root: str

    def part(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def logs(self) -> str:
        return self.part("logs")

    @property
    def minutes(self) -> str:
        return self.part("minutes")

    @property
    def state(self) -> str:
        return self.part("state")


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def folders(spark: SparkSession, path: str) -> list[str]:
    filesystem, hadoop = _filesystem(spark, path)
    if not filesystem.exists(hadoop):
        return []
    return [s.getPath().getName() for s in filesystem.listStatus(hadoop) if s.isDirectory()]


def delete_folder(spark: SparkSession, path: str) -> bool:
    filesystem, hadoop = _filesystem(spark, path)
    return filesystem.delete(hadoop, True)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    filesystem, hadoop = _filesystem(spark, path)
    if not filesystem.exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _replace_batch(rows: DataFrame, path: str, ingest_batch: str) -> None:
    """Write one ingest batch, by the UTC day its requests came; writing it again replaces it.

    Most ingest batches came on one day. Rebalancing by request too spreads that day over
    tasks, as many as its size asks for; a ``batch_id`` with very many rows is still split.
    """
    (
        rows.withColumn("received_date", utc_date(F.col("received_at")))
        .withColumn("ingest_batch", F.lit(ingest_batch))
        .hint("rebalance", "received_date", "batch_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("received_date", "ingest_batch")
        .parquet(path)
    )


def batch_folder(ingest_batch: str) -> str:
    """The folder name of an ingest batch, with its number at full width."""
    return folder_name(*split_name(ingest_batch))


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_date", utc_date(F.col("timestamp")))


def _replace_days(rows: DataFrame, path: str, ingest_batch: str, order: list) -> None:
    """Write rows with an ``event_date`` into their day, replacing what this ingest batch wrote.

    Rebalancing by day gives each day few files and still splits a heavy day over
    many tasks.
    """
    (
        rows.withColumn("ingest_batch", F.lit(ingest_batch))
        .hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "ingest_batch", *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "ingest_batch")
        .parquet(path)
    )


def write_rows(rows: DataFrame, table: LogTable, ingest_batch: str) -> None:
    """Inside a file rows sort by service, severity and time, so the row group
    statistics skip well for the usual filters."""
    order = ["service", "level", F.desc("timestamp"), F.desc("id")]
    _replace_days(rows.select(*ROW_COLUMNS, "event_date"), table.logs, ingest_batch, order)


def minute_counts(rows: DataFrame) -> DataFrame:
    """Rows with an ``event_date`` counted per minute, service and level."""
    minute = F.timestamp_millis(F.floor(F.unix_millis("timestamp") / MINUTE_MS) * MINUTE_MS)
    return rows.groupBy(
        minute.alias("timestamp"), "level", "service", "event_date"
    ).agg(F.count("*").alias("count"))


def write_minutes(counts: DataFrame, table: LogTable, ingest_batch: str) -> None:
    columns = counts.select(*MINUTE_COUNT.fieldNames()[:-1])
    _replace_days(columns, table.minutes, ingest_batch, ["service", "level", F.desc("timestamp")])


def write_logs(rows: DataFrame, table: LogTable, ingest_batch: str) -> None:
    """Write rows and their counts; these are made from the folders just written."""
    write_rows(with_day(rows.drop("event_date")), table, ingest_batch)
    written = (
        rows.sparkSession.read.schema(STORED_LOG).option("basePath", table.logs)
        .parquet(f"{table.logs}/event_date=*/ingest_batch={ingest_batch}")
    )
    write_minutes(minute_counts(written), table, ingest_batch)


def write_rejected(rejected: DataFrame, table: LogTable, ingest_batch: str) -> None:
    _replace_batch(rejected, table.part("rejected"), ingest_batch)


def write_acknowledgements(acks: DataFrame, table: LogTable, ingest_batch: str) -> None:
    stamped = acks.withColumn("committed_at", F.current_timestamp())
    _replace_batch(stamped, table.part("acknowledgements"), ingest_batch)


def reserve(
    spark: SparkSession, table: LogTable, ingest_batch: str, fingerprint: str, count: int
) -> int | None:
    """First id of the range kept for an ingest batch, or None if it is committed already.

    The range is kept before any row is written, and a replay of the same data gets
    it again. Other data under a name in use is refused: it would take the place of
    rows that have been acknowledged.
    """
    name, number = split_name(ingest_batch)

    def change(state: TableState) -> TableState:
        writer = state.writers.setdefault(name, Writer())
        if number == writer.open:
            if writer.fingerprint != fingerprint:
                raise ValueError(f"ingest batch {ingest_batch!r} was given other data before")
            return state
        if number <= max(writer.open, writer.visible):
            raise ValueError(f"ingest batch {ingest_batch!r} comes after a later one of its writer")
        if writer.open > writer.visible:
            writer.abandoned.append(writer.open)
        writer.open, writer.fingerprint, writer.first_id = number, fingerprint, state.next_id
        state.next_id += count
        return state

    writer = change_state(spark, table.state, change).writers[name]
    return None if writer.visible == number else writer.first_id


def commit(spark: SparkSession, table: LogTable, ingest_batch: str) -> None:
    """Make the rows of an ingest batch readable all at once."""
    name, number = split_name(ingest_batch)

    def change(state: TableState) -> TableState:
        state.writers.setdefault(name, Writer()).visible = number
        return state

    change_state(spark, table.state, change)


def read_logs(spark: SparkSession, table: LogTable) -> DataFrame:
    """Rows of committed ingest batches, with the ``event_date`` folder column.

    Which folders count is decided from their names, before any file is opened.
    Filters on the result reach the scan.
    """
    return read_logs_as(spark, table, read_state(spark, table.state))


def read_logs_as(spark: SparkSession, table: LogTable, state: TableState) -> DataFrame:
    """Rows that readers of a given state see."""
    return _read(spark, table.logs, STORED_LOG).filter(visible_rows(state))


def read_rollup_as(spark: SparkSession, table: LogTable, state: TableState) -> DataFrame:
    """Counts per minute, service and level of the rows that readers of a state see; one
    minute has a row for each ingest batch with rows in it."""
    return _read(spark, table.minutes, MINUTE_COUNT).filter(visible_rows(state))


def _read_answers(spark: SparkSession, table: LogTable, name: str, schema: T.StructType) -> DataFrame:
    """What was written for committed ingest batches; it becomes readable with their rows."""
    stored = _read(spark, table.part(name), T.StructType([*schema.fields, RECEIVED_DATE]))
    return stored.filter(committed_rows(read_state(spark, table.state))).drop("received_date")


def read_rejected(spark: SparkSession, table: LogTable) -> DataFrame:
    return _read_answers(spark, table, "rejected", REJECTED_ROW)


def read_acknowledgements(spark: SparkSession, table: LogTable) -> DataFrame:
    schema = T.StructType([*ACKNOWLEDGEMENT.fields, INGEST_BATCH])
    return _read_answers(spark, table, "acknowledgements", schema)


def days_of(spark: SparkSession, path: str) -> list[date]:
    """Days that have a folder below a path; other names are passed over."""
    found = (re.fullmatch(DAY_FOLDER, name) for name in folders(spark, path))
    return sorted(date.fromisoformat(match[1]) for match in found if match)


def log_days(spark: SparkSession, table: LogTable) -> list[date]:
    return days_of(spark, table.logs)
