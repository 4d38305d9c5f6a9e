"""Exact positions in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.session import shared_dir

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits


def sliced(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows in slices of a total order, with ``slice`` and ``place`` in it from 0.

    Rows are range-partitioned and sorted, and that arrangement is checkpointed:
    the ranges come from a sample, so running the shuffle twice could cut them
    differently.
    """
    shared_dir(rows.sparkSession)
    arranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    place = F.monotonically_increasing_id()
    return arranged.withColumn("place", place).select(
        *arranged.columns,
        F.shiftright("place", ROW_BITS).alias("slice"),
        F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("place"),
    )


def with_position(keys: DataFrame, *order: Column) -> DataFrame:
    """Add ``position`` (from 0) and ``total`` under the given total order.

    Each row's place inside its slice plus the size of all earlier slices is its
    position. The table of slice sizes has one row per shuffle partition, which
    bounds the broadcast.
    """
    placed = sliced(keys, *order)
    sizes = placed.groupBy("slice").agg(F.count("*").alias("size"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select(
        "slice",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
        F.sum("size").over(everything).alias("total"),
    )
    return placed.join(F.broadcast(starts), "slice").select(
        *keys.columns,
        (F.col("start") + F.col("place")).alias("position"),
        "total",
    )
