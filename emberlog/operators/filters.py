"""The one predicate builder behind every query on a log table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.arguments import LogFilter
from emberlog.functions.attributes import has_attributes
from emberlog.functions.texts import contains_text
from emberlog.functions.times import day_literal, millis_literal


def log_predicate(logs: DataFrame, wanted: LogFilter) -> Column:
    """All filters joined by AND, the ones a scan can skip data by first.

    Day folders are only skipped by a condition on the folder column, so every
    time bound also bounds ``event_date`` where the table has it.
    """
    time_type = logs.schema["timestamp"].dataType
    by_day = "event_date" in logs.columns
    checks: list[Column] = []
    if wanted.since is not None:
        if by_day:
            checks.append(F.col("event_date") >= day_literal(wanted.since))
        checks.append(F.col("timestamp") >= millis_literal(wanted.since, time_type))
    if wanted.until is not None:
        if by_day:
            checks.append(F.col("event_date") <= day_literal(wanted.until - 1))
        checks.append(F.col("timestamp") < millis_literal(wanted.until, time_type))
    if wanted.service is not None:
        checks.append(F.col("service") == F.lit(wanted.service))
    if wanted.level is not None:
        checks.append(F.col("level") == F.lit(wanted.level).cast("smallint"))
    if wanted.attributes:
        checks.append(has_attributes(F.col("attributes"), dict(wanted.attributes)))
    if wanted.q is not None:
        checks.append(contains_text(F.col("message"), wanted.q))
    return reduce(and_, checks, F.lit(True))


def after_cursor(logs: DataFrame, cursor: tuple[int, int]) -> Column:
    """Rows strictly behind a position in newest-first order.

    Written out as scalar comparisons: a struct comparison reads the same but
    never reaches the Parquet reader.
    """
    millis, id_ = cursor
    moment = millis_literal(millis, logs.schema["timestamp"].dataType)
    behind = (F.col("timestamp") <= moment) & (
        (F.col("timestamp") < moment) | (F.col("id") < F.lit(id_).cast("bigint"))
    )
    if "event_date" in logs.columns:
        behind = (F.col("event_date") <= day_literal(millis)) & behind
    return behind


def filter_logs(logs: DataFrame, wanted: LogFilter) -> DataFrame:
    return logs.filter(log_predicate(logs, wanted))
