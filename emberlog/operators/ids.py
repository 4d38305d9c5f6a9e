"""Row ids: unique, increasing in write order, the same again on a replay."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from emberlog.operators.positions import ROW_BITS
from emberlog.schema import MAX_BATCH_ENTRIES


def in_arrival_order(batches: DataFrame) -> DataFrame:
    """Raw batches in slices of arrival order, with ``request``, a number that is
    unique for each row and grows along the order, and a ``fingerprint`` of it.

    Two requests of one ``batch_id`` are two requests; which of two that are equal
    throughout comes first makes no difference.
    """
    marked = batches.withColumn("fingerprint", F.xxhash64("batch_id", "received_at", "body"))
    order = ("received_at", "batch_id", "fingerprint")
    arranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return arranged.withColumn("request", F.monotonically_increasing_id())


def slice_of(request: str = "request") -> Column:
    return F.shiftright(request, ROW_BITS)


def slice_sizes(verdicts: DataFrame) -> DataFrame:
    """``(slice, requests, fingerprint, accepted, rejected)``, one row per slice: how
    many requests it has, what they are, and what became of their entries. Every
    request has one row without an index or with the first."""
    first = F.col("index").isNull() | (F.col("index") == 0)
    return verdicts.groupBy(slice_of().alias("slice")).agg(
        F.count_if(first).alias("requests"),
        F.bit_xor(F.when(first, F.col("fingerprint"))).alias("fingerprint"),
        F.count_if(F.col("index").isNotNull() & F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    )


def slice_starts(sizes: list[Row]) -> list[tuple[int, int]]:
    """Slices with the number of requests before each; there are as many as shuffle partitions."""
    out, start = [], 0
    for row in sorted(sizes, key=lambda row: row["slice"]):
        out.append((row["slice"], start))
        start += row["requests"]
    return out


def slice_table(spark: SparkSession, starts: list[tuple[int, int]]) -> DataFrame:
    """``(slice, start)`` as rows that the plan itself holds. A frame made from a list is
    read by Python tasks, for which every micro-batch's rows would have to wait."""
    columns = zip(*starts, strict=True)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=["slice", "start"]))


def assign_ids(accepted: DataFrame, starts: DataFrame, first_id: int) -> DataFrame:
    """Give every accepted entry ``first_id + request place x 5,000 + index``.

    A request holds at most 5,000 entries, so each one owns a range of ids and no
    row-by-row numbering is needed; unused ids are gaps. The starts have one row
    per slice, which bounds the broadcast.
    """
    place = F.col("start") + F.col("request").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    id_ = F.lit(first_id).cast("bigint") + place * MAX_BATCH_ENTRIES + F.col("index")
    sliced = accepted.withColumn("slice", slice_of())
    return sliced.join(F.broadcast(starts.select("slice", "start")), "slice").withColumn("id", id_)
