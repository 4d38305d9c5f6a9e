"""Bucketed counts from a table of counts per minute, service and level.

Every ingest batch adds its own counts beside its rows, in folders of the same names,
so a count is visible exactly when its rows are, a replay replaces both, and late rows
only add further counts for their minutes. Counts of one minute are summed when read.

A request is answered from them if it filters by nothing but time, service and level
and its buckets begin on whole minutes; all four widths are whole minutes. What is left
of an end inside a minute is counted from the rows of that minute. Other requests are
counted from rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.arguments import LogFilter, parse_bucket, parse_filter, parse_group_by, require_range
from emberlog.functions.times import bucket_start_micros
from emberlog.operators.buckets import bucket_counts, counted_rows, ordered_buckets
from emberlog.operators.filters import filter_logs
from emberlog.sources.log_table import LogTable, read_logs_as, read_rollup_as
from emberlog.sources.table_state import read_state

MINUTE_MS = 60_000


def answers(wanted: LogFilter) -> bool:
    """Whether counts per minute, service and level tell what is asked."""
    return not wanted.attributes and wanted.q is None and wanted.since % MINUTE_MS == 0


def count_table(spark: SparkSession, table: LogTable, arguments: Mapping[str, object]) -> DataFrame:
    """Rows of the table per bucket as ``(start, group, count)``, from its minute counts
    where they answer; the same result as ``count_by_bucket`` on its rows."""
    return count_from(*read_counted(spark, table), arguments)


def read_counted(spark: SparkSession, table: LogTable) -> tuple[DataFrame, DataFrame]:
    """Rows and minute counts of one state of the table. Both may be kept for several
    requests, which then list no folders again and see the table as it was."""
    state = read_state(spark, table.state)
    return read_logs_as(spark, table, state), read_rollup_as(spark, table, state)


def count_from(rows: DataFrame, minutes: DataFrame, arguments: Mapping[str, object]) -> DataFrame:
    wanted = parse_filter(arguments)
    require_range(wanted)
    width, group_by = parse_bucket(arguments), parse_group_by(arguments)
    if not answers(wanted):
        return bucket_counts(rows, wanted, width, group_by)
    whole = replace(wanted, until=wanted.until // MINUTE_MS * MINUTE_MS)
    start = bucket_start_micros(F.col("timestamp"), wanted.since, width).alias("start_micros")
    keys = [start] if group_by is None else [start, F.col(group_by).alias("group")]
    counted = filter_logs(minutes, whole).groupBy(*keys).agg(F.sum("count").alias("count"))
    if whole.until < wanted.until:
        # The last bucket can have rows on both sides of the last whole minute.
        rest = counted_rows(rows, replace(wanted, since=max(whole.until, wanted.since)), width, group_by, wanted.since)
        names = [c for c in counted.columns if c != "count"]
        counted = counted.unionByName(rest).groupBy(*names).agg(F.sum("count").alias("count"))
    return ordered_buckets(counted, group_by)
