"""Newest-first listing with keyset pages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from emberlog.arguments import LogFilter, parse_cursor, parse_filter, parse_limit
from emberlog.functions.cursors import encode_cursor, token_of
from emberlog.functions.levels import decode_level
from emberlog.functions.times import iso_text
from emberlog.operators.filters import after_cursor, filter_logs
from emberlog.schema import ROW_COLUMNS


def newest_first() -> tuple[Column, Column]:
    return F.desc("timestamp"), F.desc("id")


def output_columns() -> list[Column]:
    """A row in output form: id as text, time as ISO text, severity by name."""
    return [
        F.col("id").cast("string").alias("id"),
        iso_text(F.col("timestamp")).alias("timestamp"),
        decode_level(F.col("level")).alias("level"),
        F.col("service"),
        F.col("message"),
        F.col("attributes"),
    ]


def newest(
    logs: DataFrame, wanted: LogFilter, limit: int, cursor: tuple[int, int] | None = None
) -> DataFrame:
    """The first ``limit`` matching rows behind the cursor, newest first."""
    rows = filter_logs(logs, wanted)
    if cursor is not None:
        rows = rows.filter(after_cursor(logs, cursor))
    return rows.select(*ROW_COLUMNS).orderBy(*newest_first()).limit(limit)


def newest_row(logs: DataFrame) -> DataFrame:
    return newest(logs, LogFilter(), 1)


def list_page(logs: DataFrame, arguments: Mapping[str, object]) -> DataFrame:
    """One page in output form, the token of the next page on every row.

    One row more than the page is read; when it exists, so does another page.
    The windows run over that page alone, which the argument check holds to
    1,001 rows.
    """
    limit = parse_limit(arguments)
    page = newest(logs, parse_filter(arguments), limit + 1, parse_cursor(arguments))
    order = Window.orderBy(*newest_first())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.when(F.col("place") == limit, encode_cursor(F.col("timestamp"), F.col("id")))
    marked = page.withColumn("place", F.row_number().over(order))
    marked = marked.withColumn(
        "next_cursor", F.when(F.max("place").over(whole) > limit, F.max(last).over(whole))
    )
    return (
        marked.filter(F.col("place") <= limit)
        .orderBy("place")
        .select(*output_columns(), "next_cursor")
    )


@dataclass(frozen=True)
class Page:
    logs: list[Row]
    next_cursor: str | None


def fetch_page(
    logs: DataFrame, arguments: Mapping[str, object], days: Sequence[date] | None = None
) -> Page:
    """One page brought to the driver, at most 1,001 rows.

    ``days`` are the day folders of a stored table. With them the newest days
    are read first and older ones only while the page is not full, so a page of
    recent rows does not read the whole table.
    """
    limit = parse_limit(arguments)
    wanted, cursor = parse_filter(arguments), parse_cursor(arguments)
    rows: list[Row] = []
    for span in [None] if days is None else _newest_spans(days):
        part = logs if span is None else logs.filter(F.col("event_date").between(*span))
        found = newest(part, wanted, limit + 1 - len(rows), cursor)
        rows += found.select(F.unix_millis(F.col("timestamp").cast("timestamp")).alias("millis"),
                             *output_columns()).collect()
        if len(rows) > limit:
            break
    shown = [Row(**{key: row[key] for key in ROW_COLUMNS}) for row in rows[:limit]]
    if len(rows) <= limit:
        return Page(shown, None)
    return Page(shown, token_of(rows[limit - 1]["millis"], int(rows[limit - 1]["id"])))


def _newest_spans(days: Sequence[date]) -> Iterator[tuple[date, date]]:
    """Spans of 1, 2, 4, ... days from the newest day back."""
    ordered = sorted(days, reverse=True)
    start, width = 0, 1
    while start < len(ordered):
        span = ordered[start:start + width]
        yield span[-1], span[0]
        start, width = start + width, width * 2
