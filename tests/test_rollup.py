"""Counts from the minute table equal counts from rows, whatever happened to the table."""

import random
from datetime import timedelta

import pytest
from conftest import NOW, entry, envelope
from pyspark.sql import functions as F

from emberlog.operators import maintenance, rollup
from emberlog.operators.buckets import count_by_bucket
from emberlog.operators.ingest import ingest
from emberlog.sources.batches import read_batch_table
from emberlog.sources.log_table import LogTable, read_logs, read_rollup_as
from emberlog.sources.table_state import read_state
from emberlog.streaming.ingest import start_ingest

DAY = {"since": "2031-08-09T12:00:00Z", "until": "2031-08-11T13:00:00Z"}
ASKED = [
    {**DAY, "bucket": "1m"}, {**DAY, "bucket": "1h", "group_by": "service"},
    {**DAY, "bucket": "1d", "group_by": "level"}, {**DAY, "bucket": "5m", "service": "mill", "level": "error"},
    {"since": "2031-08-10T00:07:00Z", "until": "2031-08-11T11:58:30.500Z", "bucket": "1h", "group_by": "level"},
    {"since": "2031-08-11T11:58:00Z", "until": "2031-08-11T11:58:31Z", "bucket": "1m", "group_by": "service"},
    {"since": "2031-08-11T11:58:00Z", "until": "2031-08-11T11:59:00Z", "bucket": "1m"},
]
FROM_ROWS = [
    {**DAY, "bucket": "1h", "q": "belt"}, {**DAY, "bucket": "1h", "attr.k": "v"},
    {"since": "2031-08-10T00:00:30Z", "until": "2031-08-11T13:00:00Z", "bucket": "5m"},
]


@pytest.fixture
def table(tmp_path):
    return LogTable(str(tmp_path / "table"))


def listed(frame):
    return [tuple(r) for r in frame.collect()]


def same_counts(spark, table):
    logs = read_logs(spark, table)
    found = 0
    for asked in ASKED + FROM_ROWS:
        want = listed(count_by_bucket(logs, asked))
        assert listed(rollup.count_table(spark, table, asked)) == want, asked
        found += len(want)
    return found


def entries(n, seed, days=2):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        back = timedelta(milliseconds=draw.randrange(days * 86_400_000))
        moment = (NOW - back).strftime("%Y-%m-%dT%H:%M:%S.") + f"{draw.randrange(1000):03d}Z"
        out.append(entry(timestamp=moment, service=draw.choice(["mill", "kiln", "ü"]),
                         level=draw.choice(["debug", "info", "warn", "error", "no level"])))
    return out


def test_counts_after_replays_and_late_rows(spark, table, batches):
    first = batches(envelope(*entries(60, 1)), envelope(*entries(30, 2), entry(), entry()))
    ingest(first, table, "w-0")
    assert same_counts(spark, table) > 50
    ingest(first, table, "w-0")
    late = batches(envelope(*entries(40, 3), entry(timestamp="2031-08-09T12:00:00.000Z")), prefix="late")
    ingest(late, table, "w-1")
    ingest(late, table, "w-1")
    assert same_counts(spark, table) > 80
    total = read_rollup_as(spark, table, read_state(spark, table.state)).agg(F.sum("count")).first()[0]
    assert total == read_logs(spark, table).count()


def test_counts_of_a_stream(spark, table, batches, tmp_path):
    raw = str(tmp_path / "raw")
    batches(*[envelope(*entries(20, seed)) for seed in range(6)]).repartition(3).write.parquet(raw)
    source = read_batch_table(spark, raw, stream=True, maxFilesPerTrigger=1)
    start_ingest(source, table, str(tmp_path / "progress"), drain=True).awaitTermination()
    assert same_counts(spark, table) > 50


def test_counts_after_maintenance(spark, table, batches):
    for n in range(3):
        ingest(batches(envelope(*entries(30, n, days=5)), prefix=f"r{n}-"), table, f"w-{n}")
    before = same_counts(spark, table)
    for day in ("2031-08-10", "2031-08-09"):
        maintenance.compact_day(spark, table, maintenance.date.fromisoformat(day))
    assert same_counts(spark, table) == before
    assert maintenance.purge_replaced(spark, table) > 0
    assert same_counts(spark, table) == before
    maintenance.drop_expired(spark, table, NOW.date(), retention_days=1)
    assert 0 < same_counts(spark, table) < before


def test_uncommitted_counts_are_invisible_and_empty_tables_have_none(spark, table, batches):
    assert same_counts(spark, table) == 0
    ingest(batches(envelope(entry(level="x"))), table, "w-0")
    assert same_counts(spark, table) == 0


def test_minute_counts_are_read_in_place_of_rows(spark, table, batches):
    ingest(batches(envelope(*entries(50, 1))), table, "w-0")

    def read(asked):
        return {f.split("/")[-4] for f in rollup.count_table(spark, table, asked).inputFiles()}

    assert read(ASKED[1]) == {"minutes"}
    assert read(ASKED[4]) == {"minutes", "logs"}
    assert read(FROM_ROWS[0]) == {"logs"}
    with pytest.raises(ValueError, match="after 'since'"):
        rollup.count_table(spark, table, {"since": DAY["until"], "until": DAY["since"], "bucket": "1h"})
