"""One ingest batch from raw envelopes to committed rows and answers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from emberlog.operators.acknowledge import acknowledge
from emberlog.operators.ids import assign_ids, in_arrival_order, slice_sizes, slice_starts, slice_table
from emberlog.operators.validation import accepted_entries, judge_batches, rejected_entries
from emberlog.schema import MAX_BATCH_ENTRIES, RETENTION_DAYS
from emberlog.session import configure
from emberlog.sources.log_table import (
    LogTable,
    batch_folder,
    commit,
    minute_counts,
    reserve,
    with_day,
    write_acknowledgements,
    write_minutes,
    write_rejected,
    write_rows,
)


def ingest(
    batches: DataFrame, table: LogTable, ingest_batch: str, retention_days: int = RETENTION_DAYS
) -> int:
    """Validate, store and acknowledge raw batches; returns how many there were.

    Requests are laid out by arrival once and judged in that layout. The verdicts are
    kept while the batch is written, in memory or on the executors' disks; what a lost
    executor held is judged again from the same layout, so it does not change. Rows,
    their counts, rejects and answers are independent writes and run side by side.
    Each replaces what an earlier attempt of the same ``ingest_batch`` left, and
    verdicts and ids do not change between attempts, so a lost run is simply run
    again. The commit makes all of them readable at once; of a batch that is
    committed nothing is written again. Name ingest batches ``<writer>-<number>``
    with growing numbers.
    """
    spark = configure(batches.sparkSession)
    name = batch_folder(ingest_batch)
    verdicts = judge_batches(in_arrival_order(batches), retention_days).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = slice_sizes(verdicts).collect()
        count = sum(row["requests"] for row in sizes)
        if not count:
            return 0
        whole = 0
        for row in sizes:
            whole ^= row["fingerprint"]
        accepted, rejected = (sum(row[name] for row in sizes) for name in ("accepted", "rejected"))
        first_id = reserve(
            spark, table, ingest_batch, f"{count}:{whole & (1 << 64) - 1:016x}", count * MAX_BATCH_ENTRIES
        )
        if first_id is None:
            return count
        starts = slice_table(spark, slice_starts(sizes))
        rows = with_day(accepted_entries(verdicts))
        writes = [lambda: write_acknowledgements(acknowledge(verdicts), table, name)]
        if accepted:
            writes.append(lambda: write_rows(assign_ids(rows, starts, first_id), table, name))
            writes.append(lambda: write_minutes(minute_counts(rows), table, name))
        if rejected:
            writes.append(lambda: write_rejected(rejected_entries(verdicts), table, name))
        with ThreadPoolExecutor(len(writes)) as pool:
            for done in [pool.submit(write) for write in writes]:
                done.result()
        commit(spark, table, ingest_batch)
        return count
    finally:
        verdicts.unpersist()
