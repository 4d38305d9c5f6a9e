"""Day folders: listing, calendar, retention by whole days, compaction."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.schema import LOOKAHEAD_DAYS, RETENTION_DAYS
from emberlog.functions.times import utc_midnight
from emberlog.sources.log_table import (
    LogTable,
    batch_folder,
    days_of,
    delete_folder,
    folders,
    log_days,
    read_logs_as,
    write_logs,
)
from emberlog.sources.table_state import CompactedDay, TableState, change_state, read_state, split_name

logger = logging.getLogger(__name__)


def day_partitions(days: DataFrame) -> DataFrame:
    """``(partition_name, lower_bound, upper_bound)`` of distinct ``event_date``
    values; the upper bound is exclusive."""
    day = F.col("event_date")
    return (
        days.select("event_date")
        .distinct()
        .select(
            F.date_format(day, "'logs_'yyyy_MM_dd").alias("partition_name"),
            utc_midnight(day).alias("lower_bound"),
            utc_midnight(F.date_add(day, 1)).alias("upper_bound"),
        )
    )


def required_days(
    spark: SparkSession,
    today: date,
    retention_days: int = RETENTION_DAYS,
    lookahead_days: int = LOOKAHEAD_DAYS,
) -> DataFrame:
    """Every ``event_date`` from the oldest kept day to the last one ahead."""
    first, last = today - timedelta(retention_days), today + timedelta(lookahead_days)
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(days).alias("event_date"))


def missing_partitions(days: DataFrame, required: DataFrame) -> DataFrame:
    """Required days without data. Folders appear on the first write, so this is
    a report and not a precondition."""
    present = days.select("event_date").distinct()
    return day_partitions(required.join(present, "event_date", "left_anti")).orderBy("lower_bound")


def _is_expired(upper_bound: Column, today: date, retention_days: int) -> Column:
    cutoff = utc_midnight(F.lit(today - timedelta(retention_days)).cast("date"))
    return upper_bound <= cutoff


def expired_partitions(
    days: DataFrame, today: date, retention_days: int = RETENTION_DAYS
) -> DataFrame:
    """Days that lie wholly before the retention window, oldest first."""
    expired = _is_expired(F.col("upper_bound"), today, retention_days)
    return day_partitions(days).filter(expired).orderBy("upper_bound")


def _days_frame(spark: SparkSession, days: list[date]) -> DataFrame:
    return spark.createDataFrame([(day,) for day in days], "event_date date")


def drop_expired(
    spark: SparkSession, table: LogTable, today: date, retention_days: int = RETENTION_DAYS
) -> list[date]:
    """Remove whole day folders that ran out, and the answers to requests of such
    days; a folder whose name is not a day is never touched."""
    oldest = today - timedelta(retention_days)
    dropped = [day for day in log_days(spark, table) if day < oldest]
    for day in dropped:
        for path in (table.logs, table.minutes):
            delete_folder(spark, f"{path}/event_date={day.isoformat()}")
    for part in ("rejected", "acknowledgements"):
        for day in days_of(spark, table.part(part)):
            if day < oldest:
                delete_folder(spark, f"{table.part(part)}/received_date={day.isoformat()}")

    def forget(state: TableState) -> TableState:
        state.days = {d: one for d, one in state.days.items() if date.fromisoformat(d) >= oldest}
        return state

    if any(date.fromisoformat(d) < oldest for d in read_state(spark, table.state).days):
        change_state(spark, table.state, forget)
    return dropped


@dataclass(frozen=True)
class Maintenance:
    missing: list[date]
    dropped: list[date]
    compacted: list[date]


# A closed day with more ingest batches than this is written anew as one.
MANY_BATCHES = 16


def run_maintenance(
    spark: SparkSession,
    table: LogTable,
    today: date,
    retention_days: int = RETENTION_DAYS,
    lookahead_days: int = LOOKAHEAD_DAYS,
) -> Maintenance:
    """Calendar report first, then retention, then compaction of closed days. A
    failing report ends the run; what fails later is logged and left to the next
    run. Folders that an earlier run replaced are removed before."""
    days = _days_frame(spark, log_days(spark, table))
    required = required_days(spark, today, retention_days, lookahead_days)
    gaps = required.join(days, "event_date", "left_anti").orderBy("event_date").collect()
    dropped: list[date] = []
    compacted: list[date] = []
    try:
        dropped = drop_expired(spark, table, today, retention_days)
    except Exception:
        logger.exception("removing expired days failed")
    try:
        purge_replaced(spark, table)
        for day in log_days(spark, table):
            if day < today and len(folders(spark, day_folder(table, day))) > MANY_BATCHES:
                compact_day(spark, table, day)
                compacted.append(day)
    except Exception:
        logger.exception("compaction failed")
    return Maintenance([row["event_date"] for row in gaps], dropped, compacted)


def day_folder(table: LogTable, day: date) -> str:
    return f"{table.logs}/event_date={day.isoformat()}"


def compact_day(spark: SparkSession, table: LogTable, day: date) -> str:
    """Rewrite the many small ingest batches of a closed day as one.

    The new folder stays invisible until the state names it in place of all that
    was committed when it was read. The old folders go away with
    ``purge_replaced``, once no reader that started earlier still needs them.
    """
    target = f"compact_{uuid.uuid4().hex}-0"
    seen = read_state(spark, table.state)
    stored = read_logs_as(spark, table, seen).filter(F.col("event_date") == F.lit(day))
    name = batch_folder(target)
    write_logs(stored, table, name)
    upto = {writer: one.visible for writer, one in seen.writers.items() if one.visible >= 0}
    known = seen.days.get(day.isoformat())

    def change(state: TableState) -> TableState:
        if state.days.get(day.isoformat()) != known:
            raise RuntimeError(f"{day} was compacted by another run")
        state.days[day.isoformat()] = CompactedDay(name, upto)
        return state

    change_state(spark, table.state, change)
    return name


def purge_replaced(spark: SparkSession, table: LogTable) -> int:
    """Delete folders that compaction has replaced; only folders that are there are looked at."""
    deleted = 0
    for day, one in read_state(spark, table.state).days.items():
        path = day_folder(table, date.fromisoformat(day))
        for folder in folders(spark, path):
            name = folder.removeprefix("ingest_batch=")
            writer, number = split_name(name)
            replaced = name != one.folder and writer.startswith("compact_")
            if replaced or number <= one.upto.get(writer, -1):
                delete_folder(spark, f"{table.minutes}/event_date={day}/{folder}")
                deleted += bool(delete_folder(spark, f"{path}/{folder}"))
    return deleted
