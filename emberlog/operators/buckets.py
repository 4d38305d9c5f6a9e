"""Time-bucketed counts aligned to the requested start."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from emberlog.arguments import (
    LogFilter,
    parse_bucket,
    parse_filter,
    parse_group_by,
    require_range,
)
from emberlog.functions.levels import decode_level
from emberlog.functions.times import BUCKET_MICROS, bucket_start_micros
from emberlog.operators.filters import filter_logs


def count_by_bucket(logs: DataFrame, arguments: Mapping[str, object]) -> DataFrame:
    """Rows per bucket as ``(start, group, count)``; empty buckets are left out."""
    wanted = parse_filter(arguments)
    require_range(wanted)
    return bucket_counts(
        logs, wanted, parse_bucket(arguments), parse_group_by(arguments)
    )


def bucket_counts(
    logs: DataFrame, wanted: LogFilter, width_micros: int, group_by: str | None = None
) -> DataFrame:
    return ordered_buckets(counted_rows(logs, wanted, width_micros, group_by, wanted.since), group_by)


def counted_rows(
    logs: DataFrame, wanted: LogFilter, width_micros: int, group_by: str | None, origin_millis: int
) -> DataFrame:
    """Grouping runs on whole numbers: the bucket start in microseconds and, for
    severities, the code."""
    rows = filter_logs(logs, wanted)
    start = bucket_start_micros(F.col("timestamp"), origin_millis, width_micros)
    keys = [start.alias("start_micros")]
    if group_by is not None:
        keys.append(F.col(group_by).alias("group"))
    return rows.groupBy(*keys).agg(F.count("*").alias("count"))


def ordered_buckets(counted: DataFrame, group_by: str | None) -> DataFrame:
    """Names and timestamps are made for the result rows only, and severities sort by code."""
    order = ["start_micros"] if group_by is None else ["start_micros", "group"]
    if group_by is None:
        group = F.lit(None).cast("string")
    elif group_by == "level":
        group = decode_level(F.col("group"))
    else:
        group = F.col("group")
    return counted.orderBy(*order).select(
        F.timestamp_micros("start_micros").alias("start"), group.alias("group"), "count"
    )


def totals_by_width(logs: DataFrame, wanted: LogFilter) -> DataFrame:
    """Total and number of buckets at every width; the totals must be equal.

    The widths nest, so the wider ones are summed from the one-minute counts and
    the table is read once.
    """
    minute = BUCKET_MICROS["1m"]
    start = bucket_start_micros(F.col("timestamp"), wanted.since, minute)
    minutes = (
        filter_logs(logs, wanted)
        .groupBy(start.alias("start_micros"))
        .agg(F.count("*").alias("count"))
    )
    widths = F.explode(
        F.array(*[
            F.struct(F.lit(name).alias("width"), F.lit(micros).cast("bigint").alias("micros"))
            for name, micros in BUCKET_MICROS.items()
        ])
    )
    origin = F.lit(wanted.since * 1_000)
    spread = minutes.select("start_micros", "count", widths.alias("w"))
    offset = F.pmod(F.col("start_micros") - origin, F.col("w.micros"))
    buckets = spread.groupBy(
        F.col("w.width").alias("width"), (F.col("start_micros") - offset).alias("start_micros")
    ).agg(F.sum("count").alias("count"))
    return (
        buckets.groupBy("width")
        .agg(F.count("*").alias("buckets"), F.sum("count").alias("total"))
        .orderBy("width")
    )


def busiest_service(logs: DataFrame, end_millis: int, window_hours: int) -> DataFrame:
    """The service with most rows in ``[end - window, end + 1 s)``.

    Equal counts go to the service seen in the earliest day bucket, then to the
    smaller name.
    """
    since = end_millis - window_hours * 3_600_000
    wanted = LogFilter(since=since, until=end_millis + 1_000)
    start = bucket_start_micros(F.col("timestamp"), since, BUCKET_MICROS["1d"])
    return (
        filter_logs(logs, wanted)
        .groupBy("service")
        .agg(F.count("*").alias("count"), F.min(start).alias("first_bucket"))
        .orderBy(F.desc("count"), "first_bucket", "service")
        .limit(1)
        .select("service", "count")
    )
