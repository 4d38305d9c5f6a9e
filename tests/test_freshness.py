"""Freshness of a running stream: what becomes readable, and what does not in time."""

import pytest
from conftest import entry, envelope
from pyspark.sql import functions as F

from emberlog.operators.measures import freshness
from emberlog.sources.batches import read_batch_table
from emberlog.sources.log_table import LogTable, read_logs
from emberlog.streaming.freshness import probe_stream
from emberlog.streaming.ingest import start_ingest


@pytest.mark.parametrize("timeout, visible", [(60, 4), (0.0005, 0)])
def test_requests_sent_to_a_running_stream(spark, batches, tmp_path, timeout, visible):
    raw = tmp_path / "raw"
    raw.mkdir()
    table = LogTable(str(tmp_path / "table"))
    query = start_ingest(read_batch_table(spark, str(raw), stream=True), table, str(tmp_path / "progress"))

    def send(wave):
        # The second request of each wave is refused whole, so it is no probe once it is answered.
        frame = batches(envelope(entry(), entry(message=f"m{wave}")), "{", envelope(entry(level="x"), entry()),
                        prefix=f"w{wave}-")
        frame.write.mode("append").parquet(str(raw))
        return frame

    try:
        found = probe_stream(spark, table, query, [lambda w=w: send(w) for w in range(2)], timeout).cache()
        summary = freshness(found, 1000 * timeout).first()
        rows = found.collect()
    finally:
        query.processAllAvailable()
        query.stop()
    assert summary["visible"] == visible and summary["passed"] == bool(visible)
    if visible:
        assert (summary["probes"], summary["timeouts"]) == (4, 0)
        assert all(0 < r["elapsed_ms"] < 60_000 for r in rows) and summary["max"] >= summary["p50"] >= summary["min"]
    else:
        assert summary["timeouts"] == summary["probes"] >= 4
    assert read_logs(spark, table).where(F.col("message").startswith("m")).count() == 2


def test_nothing_sent_is_refused(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    table = LogTable(str(tmp_path / "table"))
    query = start_ingest(read_batch_table(spark, str(tmp_path / "raw"), stream=True), table, str(tmp_path / "progress"))
    try:
        with pytest.raises(ValueError, match="nothing was sent"):
            probe_stream(spark, table, query, [], 1)
    finally:
        query.stop()
