"""What a table holds, for use as arguments of further queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog.functions.attributes import first_attribute_key
from emberlog.functions.texts import first_long_word
from emberlog.functions.times import iso_text, millis_text, text_millis
from emberlog.operators.buckets import busiest_service
from emberlog.operators.listing import newest_row

WINDOW_HOURS = 24


def describe_rows(logs: DataFrame) -> DataFrame:
    """First attribute and first long word of every row."""
    key = first_attribute_key(F.col("attributes"))
    return logs.select(
        "id",
        iso_text(F.col("timestamp")).alias("end"),
        "service",
        key.alias("attr_key"),
        F.col("attributes")[key].alias("attr_value"),
        first_long_word(F.col("message")).alias("word"),
    )


def discover(
    logs: DataFrame, window_hours: int = WINDOW_HOURS, until: str | None = None
) -> DataFrame:
    """End of the data or ``until``, the busiest service of the window before it,
    and first attribute and first long word of the newest row, as one record.

    No record if the table is empty or the window has no row.
    """
    if until is not None and text_millis(until) is None:
        raise ValueError(f"invalid until override: {until!r}")
    newest = describe_rows(newest_row(logs))
    found = newest.first()
    if found is None:
        return newest.drop("id")
    end = text_millis(until or found["end"])
    busiest = busiest_service(logs, end, window_hours).select("service")
    one = logs.sparkSession.createDataFrame([found], newest.schema).withColumn(
        "end", F.lit(millis_text(end))
    )
    # One row on both sides.
    return one.drop("id", "service").join(F.broadcast(busiest)).select(
        "end", "service", "attr_key", "attr_value", "word"
    )
