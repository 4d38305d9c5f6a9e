"""Stored table: ids, days, replays, streaming, retention, compaction."""

from datetime import date, datetime, timedelta

import pytest
from conftest import NOW, entry, envelope
from pyspark.sql import functions as F

from emberlog.arguments import parse_filter
from emberlog.functions.times import text_millis
from emberlog.operators import ids, maintenance
from emberlog.operators.buckets import count_by_bucket
from emberlog.operators.ingest import ingest
from emberlog.operators.listing import fetch_page
from emberlog.operators.measures import freshness, freshness_probes
from emberlog.operators.pages import page_index
from emberlog.operators.positions import with_position
from emberlog.sources.batches import read_batch_files, read_batch_table
from emberlog.sources.log_table import (
    LogTable,
    batch_folder,
    commit,
    log_days,
    read_acknowledgements,
    read_logs,
    read_rejected,
    reserve,
    write_logs,
)
from emberlog.sources.table_state import require_exclusive
from emberlog.sources.synthetic import entries_to_batches, synthetic_entries
from emberlog.streaming.ingest import start_ingest, stop_when_drained

COLUMNS = ("id", "timestamp", "level", "service", "message", "event_date")


@pytest.fixture
def table(tmp_path):
    return LogTable(str(tmp_path / "table"))


def stored(spark, table):
    return sorted(tuple(r) for r in read_logs(spark, table).select(*COLUMNS).collect())


def days_ago(days):
    return (NOW - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_ids_follow_batch_then_entry_order(spark, table, batches):
    bodies = [envelope(entry(message="a"), entry(level="x"), entry(message="b")), "no json",
              envelope(entry(message="c"))]
    assert ingest(batches(*bodies), table, "w-0") == 3
    assert ingest(batches(envelope(entry(message="d"))), table, "w-1") == 1
    rows = [(r[0], r[4]) for r in stored(spark, table)]
    assert rows == [(1, "a"), (3, "b"), (10_001, "c"), (15_001, "d")]
    assert [tuple(r) for r in read_rejected(spark, table).select("index", "reason").collect()] == [
        (1, "invalid level: 'x'")
    ]
    acks = read_acknowledgements(spark, table)
    assert sorted(r["status"] for r in acks.collect()) == [200, 200, 200, 400]


def test_requests_number_by_arrival(spark, batches):
    raw = batches(*["{}"] * 500).union(
        batches(*["{}"] * 100, received_at=NOW - timedelta(hours=1), prefix="early")
    )
    placed = ids.in_arrival_order(raw.repartition(7)).selectExpr("*", "0 index", "null reason").cache()
    starts = dict(ids.slice_starts(ids.slice_sizes(placed).collect()))
    ranks = {r["batch_id"]: starts[r["request"] >> 33] + (r["request"] & (1 << 33) - 1)
             for r in placed.collect()}
    assert sorted(ranks, key=ranks.get) == (
        [f"early{i:04d}" for i in range(100)] + [f"b{i:04d}" for i in range(500)]
    )
    assert sorted(ranks.values()) == list(range(600))


def test_positions_with_one_hot_key(spark):
    keys = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
                                     .alias("k"), "id").repartition(9)
    rows = with_position(keys, F.desc("k"), F.asc("id")).collect()
    order = sorted(((r["k"], r["id"]) for r in rows), key=lambda r: (-r[0], r[1]))
    assert [(r["k"], r["id"]) for r in sorted(rows, key=lambda r: r["position"])] == order
    assert {r["total"] for r in rows} == {5_000}


def test_repeated_batch_id_is_two_requests(spark, table, batches):
    twice = batches(envelope(entry(), entry())).union(batches(envelope(entry()))).union(batches("{"))
    assert ingest(twice, table, "w-0") == 3
    assert len({r[0] for r in stored(spark, table)}) == 3
    acks = read_acknowledgements(spark, table).collect()
    assert sorted((r["batch_id"], r["status"], r["accepted"]) for r in acks) == [
        ("b0000", 200, 1), ("b0000", 200, 2), ("b0000", 400, 0)
    ]


def test_other_data_under_a_used_name_is_refused(spark, table, batches):
    ingest(batches(envelope(entry(message="first"))), table, "w-3")
    with pytest.raises(ValueError, match="other data"):
        ingest(batches(envelope(entry(message="second"))), table, "w-3")
    with pytest.raises(ValueError, match="after a later one"):
        ingest(batches(envelope(entry(message="second"))), table, "w-2")
    assert [r[4] for r in stored(spark, table)] == ["first"]


def test_stores_without_exclusive_creation_are_refused():
    for scheme in ("file", "hdfs", "abfss"):
        require_exclusive(scheme)
    for scheme in ("s3a", "gs", "wasb"):
        with pytest.raises(ValueError, match=f"exclusively .*, not '{scheme}'"):
            require_exclusive(scheme)


def test_two_writers_never_share_an_id(spark, table, batches):
    first = reserve(spark, table, "a-0", "x", 10_000)
    second = reserve(spark, table, "b-0", "y", 5_000)
    assert (first, second, reserve(spark, table, "a-0", "x", 10_000)) == (1, 10_001, 1)


def test_an_abandoned_batch_stays_invisible(spark, table, batches):
    ingest(batches(envelope(entry(message="good"))), table, "w-0")
    reserve(spark, table, "w-1", "x", 5_000)
    write_logs(read_logs(spark, table), table, batch_folder("w-1"))
    ingest(batches(envelope(entry(message="later"))), table, "w-2")
    assert sorted(r[4] for r in stored(spark, table)) == ["good", "later"]


def test_a_request_without_clock_is_refused(spark, table, batches):
    bodies = envelope(entry(timestamp="1999-01-01T00:00:00Z"), entry(timestamp="2999-01-01T00:00:00Z"))
    ingest(batches(bodies, received_at=None), table, "w-0")
    assert stored(spark, table) == []
    (ack,) = read_acknowledgements(spark, table).collect()
    assert (ack["status"], ack["error"]) == (400, "request has no receipt time")


def test_state_stays_small_and_the_scan_has_no_join(spark, table, batches, tmp_path):
    for n in range(6):
        ingest(batches(envelope(entry(message=f"m{n}"))), table, f"w-{n}")
    assert len([p for p in (tmp_path / "table" / "state").iterdir() if p.name.isdigit()]) == 3
    plan = read_logs(spark, table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert "startswith(ingest_batch" in plan.lower().split("partitionfilters", 1)[1].split("pushedfilters")[0]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_other_session_zones_read_the_same(spark, table, batches, zone):
    texts = ["2031-08-10T02:30:00.007Z", "2031-08-09T23:59:59.999Z"]
    ingest(batches(envelope(*[entry(timestamp=t) for t in texts])), table, "w-0")
    ranged = {"since": "2031-08-09T00:00:00Z", "until": "2031-08-11T00:00:00Z", "bucket": "1d"}

    def read():
        logs = read_logs(spark, table)
        return (
            [r["timestamp"] for r in fetch_page(logs, {}, log_days(spark, table)).logs],
            [(r["start"].astimezone().timestamp(), r["count"]) for r in count_by_bucket(logs, ranged).collect()],
            [str(r["event_date"]) for r in logs.orderBy("id").collect()],
            page_index(logs, parse_filter({}), 1).count(),
        )

    expected = read()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert read() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert expected[0] == texts


def test_a_new_start_of_a_stream_keeps_earlier_rows(spark, tmp_path, table, batches):
    for n in range(2):
        raw = str(tmp_path / f"raw{n}")
        batches(envelope(entry(message=f"run {n}")), prefix=f"r{n}-").write.parquet(raw)
        source = read_batch_table(spark, raw, stream=True)
        start_ingest(source, table, str(tmp_path / f"progress{n}"), drain=True).awaitTermination()
    assert [(r[0], r[4]) for r in stored(spark, table)] == [(1, "run 0"), (5_001, "run 1")]
    assert read_acknowledgements(spark, table).count() == 2


def test_same_entry_twice_is_two_rows(spark, table, batches):
    ingest(batches(envelope(entry(), entry()), envelope(entry())), table, "w-0")
    assert len(stored(spark, table)) == 3


def test_replay_writes_the_same_rows(spark, table, batches):
    first = batches(envelope(entry(), entry(timestamp=days_ago(3))), envelope(entry(message="z")))
    ingest(first, table, "w-0")
    ingest(batches(envelope(entry(message="next"))), table, "w-1")
    before = stored(spark, table)
    ingest(batches(envelope(entry(message="next"))), table, "w-1")
    assert stored(spark, table) == before and len(before) == 4
    assert read_acknowledgements(spark, table).count() == 3


def test_uncommitted_rows_are_invisible(spark, table, batches):
    ingest(batches(envelope(entry())), table, "w-0")
    write_logs(read_logs(spark, table), table, batch_folder("w-1"))
    assert len(stored(spark, table)) == 1
    commit(spark, table, "w-1")
    assert len(stored(spark, table)) == 2


def test_slice_starts_need_no_python_task(spark):
    starts = ids.slice_table(spark, [(0, 0), (3, 7), (9, 12)])
    assert sorted(tuple(r) for r in starts.collect()) == [(0, 0), (3, 7), (9, 12)]
    assert "LocalTableScan" in starts._jdf.queryExecution().executedPlan().toString()


def test_nothing_accepted_writes_no_day(spark, table, batches):
    ingest(batches(envelope(entry(level="x"))), table, "w-0")
    assert log_days(spark, table) == [] and stored(spark, table) == []
    (ack,) = read_acknowledgements(spark, table).collect()
    assert (ack["status"], ack["error"]) == (400, "all entries rejected")


def test_answers_and_rejects_of_one_day_are_written_by_several_tasks(spark, table, batches):
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(least)
    spark.conf.set(least, "1")
    try:
        ingest(batches(*[envelope(*[entry(level=f"{i}-{j}") for j in range(50)]) for i in range(64)]), table, "w-0")
    finally:
        spark.conf.set(least, before)
    for rows, count in ((read_rejected(spark, table), 3200), (read_acknowledgements(spark, table), 64)):
        assert rows.count() == count
        assert rows.select(F.input_file_name()).distinct().count() > 1


def test_no_batches_is_a_no_op(spark, table, batches):
    assert ingest(batches(envelope(entry())).limit(0), table, "w-0") == 0
    assert read_acknowledgements(spark, table).count() == 0


def test_rows_land_in_their_utc_day(spark, table, batches):
    ingest(batches(envelope(
        entry(timestamp="2031-08-09T23:59:59.999Z"), entry(timestamp="2031-08-10T00:00:00Z"),
        entry(timestamp="2031-08-10T01:00:00+02:00"),
    )), table, "w-0")
    assert [r[5] for r in stored(spark, table)] == [
        date(2031, 8, 9), date(2031, 8, 10), date(2031, 8, 9)
    ]


def test_newest_page_stops_at_the_newest_days(spark, table, batches):
    ingest(batches(envelope(*[entry(timestamp=days_ago(d), message=f"d{d}") for d in range(1, 20)])),
           table, "w-0")
    days = log_days(spark, table)
    assert len(days) == 19
    whole = fetch_page(read_logs(spark, table), {"limit": "5"})
    early = fetch_page(read_logs(spark, table), {"limit": "5"}, days)
    assert early == whole and [r["message"] for r in early.logs] == [f"d{d}" for d in range(1, 6)]
    rest = {"limit": "100", "cursor": early.next_cursor}
    assert len(fetch_page(read_logs(spark, table), rest, days).logs) == 14
    only = {"q": "D19", "limit": "1"}
    assert fetch_page(read_logs(spark, table), only, days).logs[0]["message"] == "d19"


@pytest.mark.parametrize("micro_batches", [1, 8])
def test_stream_equals_batch(spark, tmp_path, micro_batches):
    raw = str(tmp_path / "raw")
    now = text_millis("2031-08-11T12:00:00Z")
    made = entries_to_batches(synthetic_entries(spark, 200, now, spread_days=5), now, 25)
    made.repartition(8, "batch_id").write.parquet(raw)
    batch = LogTable(str(tmp_path / "batch"))
    ingest(read_batch_table(spark, raw), batch, "w-0")
    stream = LogTable(str(tmp_path / "stream"))
    source = read_batch_table(spark, raw, stream=True, maxFilesPerTrigger=8 // micro_batches)
    query = start_ingest(source, stream, str(tmp_path / "progress"), drain=True)
    query.awaitTermination()
    assert query.exception() is None
    rows = [[r[1:] for r in stored(spark, t)] for t in (batch, stream)]
    assert sorted(rows[0]) == sorted(rows[1]) and len(rows[0]) == 200
    assert len({r[0] for r in stored(spark, stream)}) == 200
    answers = [
        sorted((r["batch_id"], r["accepted"]) for r in read_acknowledgements(spark, t).collect())
        for t in (batch, stream)
    ]
    assert answers[0] == answers[1] and len(answers[0]) == 8


def test_stream_of_request_files_takes_late_files_and_drains(spark, tmp_path, table):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    now = datetime.now().astimezone().strftime("%Y-%m-%dT%H:%M:%S%z")

    def send(name, *messages):
        (inbox / name).write_text(envelope(*[entry(timestamp=now, message=m) for m in messages]))

    send("one.json", "a", "b")
    (inbox / "two.json").write_text("{")
    source = read_batch_files(spark, str(inbox), stream=True)
    query = start_ingest(source, table, str(tmp_path / "progress"))
    query.processAllAvailable()
    send("three.json", "c")
    stop_when_drained(query)
    assert sorted(r[4] for r in stored(spark, table)) == ["a", "b", "c"]
    acks = read_acknowledgements(spark, table)
    assert sorted(r["status"] for r in acks.collect()) == [200, 200, 400]
    probe = freshness(freshness_probes(acks)).first()
    assert probe["probes"] == 3 and probe["min"] > 0


def test_stream_replays_its_last_micro_batch(spark, tmp_path, table):
    """The commit log of the stream loses its last entry, as after a crash."""
    raw, progress = str(tmp_path / "raw"), tmp_path / "progress"
    now = text_millis("2031-08-11T12:00:00Z")
    made = entries_to_batches(synthetic_entries(spark, 100, now), now, 25)
    made.repartition(4, "batch_id").write.parquet(raw)

    def run():
        source = read_batch_table(spark, raw, stream=True, maxFilesPerTrigger=2)
        start_ingest(source, table, str(progress), drain=True).awaitTermination()

    run()
    before = stored(spark, table)
    last = max((progress / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert stored(spark, table) == before and len(before) == 100


def test_retention_keeps_day_30_and_drops_day_31(spark, table, batches, tmp_path):
    old = batches(envelope(*[entry(timestamp=days_ago(d)) for d in (0, 30)]))
    ingest(old, table, "w-0")
    later = date(2031, 8, 12)
    (tmp_path / "table" / "logs" / "event_date=other").mkdir()
    result = maintenance.run_maintenance(spark, table, date(2031, 8, 11))
    assert result.dropped == [] and len(result.missing) == 45 - 2
    result = maintenance.run_maintenance(spark, table, later)
    assert result.dropped == [date(2031, 7, 12)]
    assert log_days(spark, table) == [date(2031, 8, 11)]
    assert (tmp_path / "table" / "logs" / "event_date=other").exists()
    assert len(stored(spark, table)) == 1


def test_calendar_reports(spark):
    days = spark.createDataFrame([(date(2031, 7, 11),), (date(2031, 7, 12),)], "event_date date")
    today = date(2031, 8, 11)
    expired = maintenance.expired_partitions(days, today).collect()
    assert [r["partition_name"] for r in expired] == ["logs_2031_07_11"]
    assert expired[0]["upper_bound"] == datetime(2031, 7, 12)
    missing = maintenance.missing_partitions(days, maintenance.required_days(spark, today))
    names = [r["partition_name"] for r in missing.collect()]
    assert len(names) == 44 and names[0] == "logs_2031_07_13" and names[-1] == "logs_2031_08_25"


def test_compaction_changes_no_row(spark, table, batches, tmp_path):
    for n in range(3):
        ingest(batches(envelope(entry(message=f"m{n}"), entry(timestamp=days_ago(2)))), table,
               f"w-{n}")
    before = stored(spark, table)
    target = maintenance.compact_day(spark, table, date(2031, 8, 9))
    assert stored(spark, table) == before
    assert maintenance.purge_replaced(spark, table) == 3
    assert stored(spark, table) == before
    day = tmp_path / "table" / "logs" / "event_date=2031-08-09"
    assert [p.name for p in day.iterdir() if p.is_dir()] == [f"ingest_batch={target}"]
    ingest(batches(envelope(entry(timestamp=days_ago(2), message="late"))), table, "w-3")
    assert len(stored(spark, table)) == 7


def test_synthetic_entries_are_valid_and_repeatable(spark, table):
    now = text_millis("2031-08-11T12:00:00Z")
    made = synthetic_entries(spark, 2_000, now, spread_days=3, seed=7)
    assert made.exceptAll(synthetic_entries(spark, 2_000, now, spread_days=3, seed=7)).isEmpty()
    assert not made.exceptAll(synthetic_entries(spark, 2_000, now, spread_days=3)).isEmpty()
    ingest(entries_to_batches(made, now), table, "w-0")
    logs = read_logs(spark, table)
    assert logs.count() == 2_000
    assert logs.select("service").distinct().count() == 8
    assert logs.select("level").distinct().count() == 4
    assert logs.select(F.col("attributes")["region"]).distinct().count() == 5
    assert logs.select("message").distinct().count() == 10
