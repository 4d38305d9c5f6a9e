"""Tables, scratch tables, fixed-size bit sets and connected documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.llm.words import U64, mix
from emberlog.session import scratch_dir

# One part of a bit set or counter table that is merged by one task at a time.
BLOCK = 1 << 13


# Rows and bytes that Spark hands to a Python task at once, which bounds its memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the bounds above where the session's own are larger."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key).rstrip("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back, which cuts its lineage."""
    spark = frame.sparkSession
    small_batches(spark)
    path = scratch_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def merge_blocks(parts: DataFrame, dtype: str, either: bool) -> DataFrame:
    """Rows (block, body) merged into one row for each block: bits by or, counters by sum.

    A task holds one running array for each of its blocks, however many rows come.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(body, dtype)
                if block not in held:
                    held[block] = part.copy()
                elif either:
                    held[block] |= part
                else:
                    held[block] += part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
            names=["block", "body"],
        )

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "block").mapInArrow(merge, "block long, body binary")


def blocks_of(array: np.ndarray) -> pa.RecordBatch:
    """An array as rows (block, body); blocks without any bit are left out."""
    parts = [array[i : i + BLOCK] for i in range(0, len(array), BLOCK)]
    kept = [(i, x.tobytes()) for i, x in enumerate(parts) if x.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.binary())],
        names=["block", "body"],
    )


def gathered(blocks: DataFrame, size: int, dtype: str) -> np.ndarray:
    """The whole array on the driver; its size is fixed, whatever the rows are."""
    out = np.zeros(size, dtype)
    for block, body in blocks.collect():
        part = np.frombuffer(body, dtype)
        out[block * BLOCK : block * BLOCK + len(part)] = part
    return out


def places(keys: np.ndarray, log_bits: int) -> np.ndarray:
    return mix(keys.astype(np.int64, copy=False).view(U64)) >> U64(64 - log_bits)


class BitSet:
    """A fixed number of bits that tells of a 64-bit key whether it may be in a set.

    A key that is in the set always passes. Others pass more often as the set
    grows, so every use is followed by an exact join: the bits only save shuffles.
    """

    LOG_BITS, MOST_LOG_BITS = 24, 28

    def __init__(self, keys: DataFrame, count: int = 0):
        """``count``, where it is known, gives eight bits to each key, up to 32 MiB in all."""
        log_bits = self.log_bits = min(max(self.LOG_BITS, (8 * count).bit_length()), self.MOST_LOG_BITS)

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << (log_bits - 3), np.uint8)
            for batch in batches:
                found = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                place = places(found, log_bits)
                np.bitwise_or.at(bits, place >> U64(3), (U64(1) << (place & U64(7))).astype(np.uint8))
            yield blocks_of(bits)

        rows = keys.mapInArrow(collect, "block long, body binary")
        merged = merge_blocks(rows, "uint8", either=True)
        bits = gathered(merged, 1 << (log_bits - 3), "uint8")
        self.sent = keys.sparkSession.sparkContext.broadcast(bits)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        place = places(keys, self.log_bits)
        return (self.sent.value[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1


    def named(self, batches: Iterator[pa.RecordBatch], key: str = "doc_id") -> Iterator[pa.RecordBatch]:
        """The rows whose key may be in the set."""
        for batch in batches:
            yield batch.filter(pa.array(self.of(batch.column(key))))

    def of(self, keys: pa.Array) -> np.ndarray:
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        return known & self.passes(keys.fill_null(0).to_numpy(zero_copy_only=False))


def rows_named(frame: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The frame's rows whose key may be among the ids; an exact join must follow."""
    bits = BitSet(ids.select(F.col(key).cast("long")))
    return frame.mapInArrow(lambda batches: bits.named(batches, key), frame.schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges (a, b) lead to, for every id on an edge.

    Each round every id takes the smallest label around it and then the label of
    that label, until nothing changes; labels are cut from their lineage each
    round. Minima are combined before the shuffle, so an id with very many edges
    is not gathered anywhere.
    """
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), "labels"
    )
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("component").alias("near")
        )
        nearer = labels.join(seen, "id").select(
            "id", "component", F.least("component", "near").alias("near")
        )
        heads = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        jumped = stored(
            nearer.join(heads, "near").select("id", "component", F.least("near", "far").alias("far")),
            "labels",
        )
        labels = jumped.select("id", F.col("far").alias("component"))
        if not jumped.where(F.col("far") < F.col("component")).limit(1).count():
            return labels
