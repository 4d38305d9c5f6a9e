"""Made-up log entries for volume tests, drawn by hash from seeded row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.functions.times import iso_text
from emberlog.schema import DAY_MS, LEVELS, MAX_BATCH_ENTRIES

# What a generated entry is drawn from: eight services, five regions, ten messages.
SERVICES = ("ferry", "lantern", "mill", "orchard", "quarry", "sawyer", "tannery", "weaver")
REGIONS = ("delta", "fjord", "mesa", "steppe", "tundra")
MESSAGES = (
    "shift began", "shift ended", "belt slipped", "stock is low", "gauge out of range",
    "pump restarted", "crate weighed", "door left open", "order was split", "lamp replaced",
)
USERS = 100_000
RETRIES = 5
LIVE_SPREAD_MS = 60_000


def synthetic_entries(
    spark: SparkSession, rows: int, now_millis: int, spread_days: int = 0, seed: int = 0
) -> DataFrame:
    """``rows`` entries, every column an independent uniform draw; times fall in
    the last ``spread_days`` days, or in the last minute for 0."""
    spread = spread_days * DAY_MS if spread_days > 0 else LIVE_SPREAD_MS

    def draw(salt: int, bound: int) -> Column:
        return F.pmod(F.xxhash64(F.col("n"), F.lit(seed), F.lit(salt)), F.lit(bound))

    def pick(salt: int, values: Sequence[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (draw(salt, len(values)) + 1).cast("int"))

    return spark.range(rows).withColumnRenamed("id", "n").select(
        "n",
        F.timestamp_millis(F.lit(now_millis) - draw(1, spread)).alias("timestamp"),
        pick(2, LEVELS).alias("level"),
        pick(3, SERVICES).alias("service"),
        pick(4, MESSAGES).alias("message"),
        F.struct(
            draw(5, USERS).cast("string").alias("user_id"),
            pick(6, REGIONS).alias("region"),
            draw(7, RETRIES).alias("retries"),
        ).alias("attributes"),
    )


def entries_to_batches(
    entries: DataFrame, received_millis: int, batch_size: int = 500
) -> DataFrame:
    """Pack entries into envelopes of ``batch_size`` by row number."""
    if not 1 <= batch_size <= MAX_BATCH_ENTRIES:
        raise ValueError(f"batch size out of range: {batch_size}")
    entry = F.to_json(
        F.struct(iso_text(F.col("timestamp")).alias("timestamp"),
                 "level", "service", "message", "attributes")
    )
    number = F.floor(F.col("n") / batch_size)
    packed = entries.groupBy(number.alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("n", entry.alias("entry")))).alias("entries")
    )
    return packed.select(
        F.format_string("batch-%012d", "batch").alias("batch_id"),
        F.timestamp_millis(F.lit(received_millis)).alias("received_at"),
        F.concat(F.lit('{"logs":['), F.array_join("entries.entry", ","), F.lit("]}")).alias("body"),
    )
