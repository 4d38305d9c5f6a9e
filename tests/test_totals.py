"""Totals from footers equal those from rows, and no row is read for them."""

from conftest import entry, envelope
from pyspark.sql import functions as F

from emberlog.operators import maintenance, totals
from emberlog.operators.ingest import ingest
from emberlog.sources.log_table import LogTable, batch_folder, log_days, read_logs, write_logs


def from_rows(spark, table):
    return read_logs(spark, table).groupBy("event_date").agg(
        F.count("*"), F.min("id"), F.max("id"), F.min("level"), F.max("level")
    )


def same(spark, table):
    got = sorted(tuple(r) for r in totals.day_totals(spark, table).drop("batches").collect())
    assert got == sorted(tuple(r) for r in from_rows(spark, table).collect())
    return len(got)


def test_totals_of_a_table(spark, batches, tmp_path):
    table = LogTable(str(tmp_path / "table"))
    assert same(spark, table) == 0
    days = [f"2031-08-{d:02d}T10:00:00Z" for d in (3, 5, 9)]
    for n in range(3):
        bodies = [envelope(*[entry(timestamp=d, level=lv) for d in days[n:] for lv in ("warn", "error", "info")])] * 2
        ingest(batches(*bodies, prefix=f"r{n}-"), table, f"w-{n}")
    assert same(spark, table) == 3
    assert {r["batches"] for r in totals.day_totals(spark, table).collect()} == {1, 2, 3}
    # Rows that are not committed, and days that were rewritten.
    write_logs(read_logs(spark, table), table, batch_folder("w-7"))
    assert same(spark, table) == 3
    maintenance.compact_day(spark, table, log_days(spark, table)[1])
    assert same(spark, table) == 3
    plan = totals.folder_totals(spark, table)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id), MIN(level), MAX(level)]" in plan
    assert "PushedGroupBy: [event_date, ingest_batch]" in plan
    # Readers of the caller's own session are left as they were.
    assert "BatchScan" not in from_rows(spark, table)._jdf.queryExecution().executedPlan().toString()
