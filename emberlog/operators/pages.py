"""The whole walk over all pages at once, as an index of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog.arguments import LogFilter
from emberlog.functions.cursors import encode_cursor
from emberlog.operators.filters import filter_logs
from emberlog.operators.listing import newest_first
from emberlog.operators.positions import with_position


def page_index(logs: DataFrame, wanted: LogFilter, limit: int) -> DataFrame:
    """``(page, rows, first_timestamp, first_id, last_timestamp, last_id,
    next_cursor)``, the pages a reader gets by following cursors to the end.

    Only the two key columns are ordered. Rows of a page sit next to each other,
    so the partial aggregation leaves about one record per page to shuffle.
    """
    keys = filter_logs(logs, wanted).select("timestamp", "id")
    placed = with_position(keys, *newest_first())
    # Only fixed-width buffers, so this stays a hash aggregation.
    pages = placed.groupBy((F.floor(F.col("position") / limit) + 1).alias("page")).agg(
        F.count("*").alias("rows"),
        F.min_by("timestamp", "position").alias("first_timestamp"),
        F.min_by("id", "position").alias("first_id"),
        F.max_by("timestamp", "position").alias("last_timestamp"),
        F.max_by("id", "position").alias("last_id"),
        F.max("position").alias("end"),
        F.max("total").alias("total"),
    )
    token = encode_cursor(F.col("last_timestamp"), F.col("last_id"))
    return pages.orderBy("page").select(
        "page",
        "rows",
        "first_timestamp",
        "first_id",
        "last_timestamp",
        "last_id",
        F.when(F.col("end") + 1 < F.col("total"), token).alias("next_cursor"),
    )
