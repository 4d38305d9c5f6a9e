"""Vectors packed into blocks of bounded size, and cells of a block and a group of queries.

A block holds up to so many vectors of one kind, as one row: their ids, labels and one
matrix. Kinds are what must be equal for a query and a row to meet (the length of the
vectors, or a part of an index). Blocks come from ranges of (kind, label, hash of the
id), so they are about equally large whatever kinds or labels are frequent, and most
hold few labels. Each cell is one task's work: one block and one group of queries.
Both sides go to a cell by its key, so nothing gathers all blocks or all queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

# Bytes of a block's matrix, and vectors in a group of queries.
BLOCK_BYTES = 2 << 20
GROUP_ROWS = 512
# No more tasks than this for the cells of a join, however many cells there are.
MOST_TASKS = 100_000

PACKED = (
    "part long, piece long, kind long, low long, high long, n long, ids binary, labels binary, "
    "vectors binary, extra binary"
)


def one_per_id(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, vector) with usable vectors, one for each vec_id.

    Left out: null ids, and vectors that are null, empty, or hold null or non-finite
    components. Of several different rows of one id that with the least (label,
    vector) stays; equal ones are one.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite)
    return sound.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select(
        "vec_id", "r.label", "r.vector"
    )


def packed(rows: DataFrame, dtype: str, most_rows: int | None = None, extra: str | None = None) -> DataFrame:
    """Rows (vec_id, kind, label, vector) in blocks; ``extra`` names a binary column to go with them.

    Blocks hold BLOCK_BYTES of vectors, or ``most_rows`` of them.
    """
    width = np.dtype(dtype).itemsize
    size = rows.agg(F.sum(F.size("vector").cast("long") * width), F.count("*")).first()
    parts = -(-(size[1] if most_rows else size[0] or 0) // (most_rows or BLOCK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        room = 0

        def block() -> pa.RecordBatch:
            nonlocal piece, room
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            room = 0
            labels = table.column("label").to_numpy()
            vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            further = b"".join(table.column("extra").to_pylist()) if extra else b""
            row = (
                part, piece, table.column("kind")[0].as_py(), int(labels.min()), int(labels.max()), len(table),
                table.column("vec_id").to_numpy().astype("<i8").tobytes(), labels.astype("<i8").tobytes(),
                vectors.astype(dtype).tobytes(), further,
            )
            piece += 1
            schema = pa.schema([(c.split()[0], pa.binary() if "binary" in c else pa.int64()) for c in PACKED.split(", ")])
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema
            )

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column("kind")[0].as_py() != kinds[low]:
                    yield block()
                while low < high:
                    if not held:
                        each = len(batch.column("vector")[low]) * width
                        room = most_rows or max(BLOCK_BYTES // each, 1)
                    taken = min(high - low, room)
                    held.append(batch.slice(low, taken))
                    low, room = low + taken, room - taken
                    if not room:
                        yield block()
        if held:
            yield block()

    columns = ["kind", "label", "vec_id", "vector", *([F.col(extra).alias("extra")] if extra else [])]
    ordered = rows.withColumn("mixed", F.xxhash64("vec_id")).repartitionByRange(
        max(parts, 1), "kind", "label", "mixed"
    ).sortWithinPartitions("kind", "label", "mixed").coalesce(max(parts, 1))
    return ordered.select(*columns).mapInArrow(run, PACKED)


def cells(blocks: DataFrame, groups: DataFrame, meet: Column) -> DataFrame:
    """Rows with a block's columns as b_… and a group's as g_…, for those that ``meet``.

    The condition may use kind, low and high of both. Both frames are stored tables.
    """
    parts = groups.agg(F.max("part")).first()[0]
    small = ("part", "piece", "kind", "low", "high")
    b = blocks.select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns])
    g = groups.select(*[F.col(c).alias(f"g_{c}") for c in groups.columns])
    if parts is None:
        return b.join(g, F.lit(False))
    keys = (
        b.select(*[f"b_{c}" for c in small])
        .withColumn("g_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts).cast("long"))))
        .join(g.select(*[f"g_{c}" for c in small]), "g_part")
        .where((F.col("b_kind") == F.col("g_kind")) & meet)
        .select("b_part", "b_piece", "g_part", "g_piece")
    )
    tasks = min(max(keys.count(), 1), MOST_TASKS)
    key = ["b_part", "b_piece", "g_part", "g_piece"]
    left = keys.join(b, ["b_part", "b_piece"]).repartition(tasks, *key)
    right = keys.join(g, ["g_part", "g_piece"]).repartition(tasks, *key)
    return left.join(right.hint("merge"), key)


def matrix(row: dict, side: str, dtype: str) -> np.ndarray:
    return np.frombuffer(row[f"{side}_vectors"], dtype).reshape(row[f"{side}_n"], -1)


def numbers(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(row[name], "<i8")
