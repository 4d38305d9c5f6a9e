"""How long a running stream takes to make what it is sent readable.

Requests are sent while the stream runs. A listener tells of each micro-batch that has
ended; only then is the table read, through the same reader as by any query, and the
requests whose answers and rows are there are visible from that moment. Requests that
are not visible in time are timeouts and have no time.
"""

from __future__ import annotations

import queue
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from emberlog.sources.log_table import LogTable, read_acknowledgements, read_logs


class Ended(StreamingQueryListener):
    """Puts the end of each micro-batch of one query into a queue."""

    def __init__(self, query: StreamingQuery):
        self.id, self.ends = query.id, queue.Queue()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == str(self.id):
            self.ends.put(event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == str(self.id):
            self.ends.put(None)


def readable_batches(spark: SparkSession, table: LogTable, known: set[str]) -> set[str]:
    """Ingest batches whose answers can be read, and their rows if they have any, beyond those known.

    There are as many as the stream had micro-batches meanwhile.
    """
    unseen = ~F.col("ingest_batch").isin(list(known)) if known else F.lit(True)
    answered = read_acknowledgements(spark, table).where(unseen).groupBy("ingest_batch").agg(
        F.sum("accepted").alias("accepted")
    )
    rows = read_logs(spark, table).where(unseen).groupBy("ingest_batch").agg(F.count("*").alias("rows"))
    whole = F.coalesce("rows", F.lit(0)) >= F.col("accepted")
    return {r["ingest_batch"] for r in answered.join(rows, "ingest_batch", "left").where(whole).collect()}


def probe_stream(
    spark: SparkSession,
    table: LogTable,
    query: StreamingQuery,
    sends: Iterable[Callable[[], DataFrame]],
    timeout_seconds: float,
) -> DataFrame:
    """``(batch_id, elapsed_ms)`` of every request sent that has accepted entries; null after a timeout.

    Each of ``sends`` hands requests to the stream's source and gives their batch ids.
    """
    listener = Ended(query)
    spark.streams.addListener(listener)
    sent: list[tuple[DataFrame, float]] = []
    seen: dict[str, float] = {}

    def look(wait: float) -> bool:
        """Wait for a micro-batch to end and note what is readable; False if none ended."""
        try:
            listener.ends.get(timeout=max(wait, 0))
        except queue.Empty:
            return False
        while not listener.ends.empty():
            listener.ends.get()
        for name in readable_batches(spark, table, set(seen)):
            seen[name] = time.time()
        return True

    def missing() -> int:
        answered = read_acknowledgements(spark, table).select("batch_id")
        return all_sent().join(answered, "batch_id", "left_anti").limit(1).count()

    def all_sent() -> DataFrame:
        frames = [ids.withColumn("sent_at", F.lit(at)) for ids, at in sent]
        out = frames[0]
        for frame in frames[1:]:
            out = out.union(frame)
        return out

    try:
        for send in sends:
            at = time.time()
            sent.append((send().select("batch_id"), at))
            look(0)
        if not sent:
            raise ValueError("nothing was sent")
        last = time.time() + timeout_seconds
        while missing() and time.time() < last and query.isActive:
            look(min(1.0, last - time.time()))
        look(1.0)
        for name in readable_batches(spark, table, set(seen)):
            seen[name] = time.time()
    finally:
        spark.streams.removeListener(listener)
    times = spark.createDataFrame(list(seen.items()), "ingest_batch string, visible_at double")
    visible = read_acknowledgements(spark, table).join(F.broadcast(times), "ingest_batch").select(
        "batch_id", "visible_at", "accepted"
    )
    waited = (F.col("visible_at") - F.col("sent_at")) * 1000
    return all_sent().join(visible, "batch_id", "left").where("accepted is null or accepted > 0").select(
        "batch_id", F.when(waited <= timeout_seconds * 1000, waited).alias("elapsed_ms")
    )
