"""The answer to every batch: accepted count, rejected list, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog.operators.validation import BODY_TOO_LARGE

ALL_REJECTED = "all entries rejected"


def acknowledge(verdicts: DataFrame) -> DataFrame:
    """``(batch_id, received_at, status, error, accepted, rejected)`` per batch.

    A batch holds at most 5,000 entries, which bounds its rejected list. Entries
    of one batch come out of one row, so the partial aggregation already brings
    each batch down to one record before the shuffle.
    """
    rejected = F.when(F.col("reason").isNotNull(), F.struct("index", "reason"))
    counted = verdicts.groupBy("batch_id", "received_at", "request", "envelope_error").agg(
        F.count_if(F.col("index").isNotNull() & F.col("reason").isNull()).alias("accepted"),
        F.array_sort(F.collect_list(rejected)).alias("rejected"),
    )
    error = F.coalesce(
        F.col("envelope_error"), F.when(F.col("accepted") == 0, F.lit(ALL_REJECTED))
    )
    status = (
        F.when(F.col("envelope_error") == BODY_TOO_LARGE, 413)
        .when(error.isNotNull(), 400)
        .otherwise(200)
    )
    return counted.select(
        "batch_id", "received_at", status.alias("status"), error.alias("error"),
        "accepted", "rejected",
    )
