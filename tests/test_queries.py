"""Listing, pages and counts on a short series and on tied times."""

import base64
from datetime import date, datetime, timedelta

import pytest

from emberlog.arguments import LogFilter, parse_filter
from emberlog.functions.cursors import decode_cursor, encode_cursor
from emberlog.functions.times import text_millis
from emberlog.operators.buckets import busiest_service, count_by_bucket, totals_by_width
from emberlog.operators.discovery import discover
from emberlog.operators.filters import after_cursor, filter_logs
from emberlog.operators.listing import fetch_page, list_page
from emberlog.operators.pages import page_index
from emberlog.schema import STORED_LOG
from pyspark.sql import functions as F

START = datetime(2031, 5, 3, 14, 0)
SINCE, UNTIL = "2031-05-03T14:00:00Z", "2031-05-03T15:00:00Z"
TONES = ("Low hum", "high RATTLE", "steady tick")


def row(id_, time, level=1, service="svc", message="m", **attributes):
    return (id_, time, level, service, message, attributes, time.date(), "load-0")


@pytest.fixture(scope="module")
def series(spark):
    """Fifteen rows of one mill two minutes apart, every fourth a warning, and one of a quay."""
    rows = [
        row(i + 1, START + timedelta(minutes=2 * i), 2 if i % 4 == 1 else 0, "mill",
            f"{TONES[i % 3]} at gear {i}", line=f"L{i % 5}", turn=str(100 + i))
        for i in range(15)
    ]
    rows.append(row(16, START, 0, "quay", "Low hum at the crane", line="L0"))
    return spark.createDataFrame(rows, STORED_LOG)


def ids(page):
    return [int(r["id"]) for r in page.logs]


@pytest.mark.parametrize("arguments, found", [
    ({}, 15), ({"level": "warn"}, 4), ({"level": "debug"}, 11), ({"level": "error"}, 0),
    ({"attr.turn": "107"}, 1), ({"attr.line": "L2"}, 3),
    ({"attr.line": "L2", "attr.turn": "107"}, 1), ({"attr.line": "L1", "attr.turn": "107"}, 0),
    ({"attr.missing": ""}, 0), ({"q": "low"}, 5), ({"q": "RATTLE"}, 5), ({"q": "rattle AT"}, 5),
    ({"q": "%"}, 0), ({"q": "_"}, 0), ({"q": "\\"}, 0), ({"q": "gear 1"}, 6),
    ({"since": "2031-05-03T14:10:00Z"}, 10), ({"until": "2031-05-03T14:10:00Z"}, 5),
    ({"since": "2031-05-03T14:10:00Z", "until": "2031-05-03T14:13:00Z"}, 2),
    ({"service": "MILL"}, 0),
])
def test_filters_agree_between_list_and_count(series, arguments, found):
    arguments = {"service": "mill", **arguments}
    assert len(fetch_page(series, arguments).logs) == found
    ranged = {"since": SINCE, "until": UNTIL, "bucket": "5m", **arguments}
    assert sum(r["count"] for r in count_by_bucket(series, ranged).collect()) == found


def test_output_form(series):
    (shown,) = fetch_page(series, {"service": "mill", "limit": "1"}).logs
    assert shown.asDict() == {
        "id": "15", "timestamp": "2031-05-03T14:28:00.000Z", "level": "debug", "service": "mill",
        "message": "steady tick at gear 14", "attributes": {"line": "L4", "turn": "114"},
    }


def test_pages_of_four(series):
    sizes, seen, cursor = [], [], None
    while True:
        arguments = {"service": "mill", "limit": "4", **({"cursor": cursor} if cursor else {})}
        page = fetch_page(series, arguments, days=[date(2031, 5, 2), date(2031, 5, 3)])
        frame = list_page(series, arguments).collect()
        assert [r["id"] for r in frame] == [r["id"] for r in page.logs]
        assert {r["next_cursor"] for r in frame} == {page.next_cursor}
        sizes.append(len(page.logs))
        seen += ids(page)
        cursor = page.next_cursor
        if cursor is None:
            break
    assert sizes == [4, 4, 4, 3] and seen == list(range(15, 0, -1))


def test_last_full_page_has_no_cursor(series):
    assert fetch_page(series, {"service": "mill", "limit": "15"}).next_cursor is None
    assert {r["next_cursor"] for r in list_page(series, {"service": "mill", "limit": "15"}).collect()
            } == {None}
    assert list_page(series, {"service": "none"}).collect() == []


@pytest.mark.parametrize("bucket, buckets", [("1m", 15), ("5m", 6), ("1h", 1), ("1d", 1)])
def test_totals_at_every_width(series, bucket, buckets):
    arguments = {"service": "mill", "since": SINCE, "until": UNTIL, "bucket": bucket}
    rows = count_by_bucket(series, arguments).collect()
    assert len(rows) == buckets and sum(r["count"] for r in rows) == 15
    assert {r["group"] for r in rows} == {None}


def test_totals_by_width(series):
    wanted = parse_filter({"service": "mill", "since": SINCE})
    rows = {r["width"]: (r["buckets"], r["total"]) for r in
            totals_by_width(series, wanted).collect()}
    assert rows == {"1m": (15, 15), "5m": (6, 15), "1h": (1, 15), "1d": (1, 15)}


def test_first_bucket_starts_at_since(series):
    arguments = {"since": "2031-05-03T13:59:30.500Z", "until": UNTIL, "bucket": "5m"}
    first = count_by_bucket(series, arguments).first()
    assert first["start"] == datetime(2031, 5, 3, 13, 59, 30, 500_000)


def test_groups_sort_by_severity(series):
    arguments = {"since": SINCE, "until": UNTIL, "bucket": "1h", "group_by": "level"}
    rows = count_by_bucket(series, arguments).collect()
    assert [(r["group"], r["count"]) for r in rows] == [("debug", 12), ("warn", 4)]
    by_service = count_by_bucket(series, {**arguments, "group_by": "service"}).collect()
    assert [(r["group"], r["count"]) for r in by_service] == [("mill", 15), ("quay", 1)]


def test_count_needs_a_range(series):
    with pytest.raises(ValueError, match="'since' is required"):
        count_by_bucket(series, {"until": UNTIL, "bucket": "1h"})


@pytest.fixture(scope="module")
def tied(spark):
    """A third of all rows share one time."""
    hot = [row(i, START) for i in range(1, 401)]
    rest = [row(i, START + timedelta(seconds=(i * 37) % 900 - 450)) for i in range(401, 1201)]
    return spark.createDataFrame(hot + rest, STORED_LOG).repartition(7)


def newest_ids(logs):
    keys = [(r["timestamp"], r["id"]) for r in logs.select("timestamp", "id").collect()]
    return [id_ for _, id_ in sorted(keys, reverse=True)]


def test_walk_over_ties_sees_every_row_once(tied):
    seen, cursor = [], None
    while True:
        page = fetch_page(tied, {"limit": "300", **({"cursor": cursor} if cursor else {})})
        seen += ids(page)
        cursor = page.next_cursor
        if cursor is None:
            break
    assert seen == newest_ids(tied)


@pytest.mark.parametrize("limit", [1, 7, 100, 1000, 1200, 5000])
def test_page_index_equals_the_walk(tied, limit):
    order = newest_ids(tied)
    pages = page_index(tied, LogFilter(), limit).collect()
    chunks = [order[i:i + limit] for i in range(0, len(order), limit)]
    assert [p["page"] for p in pages] == list(range(1, len(chunks) + 1))
    assert [(p["rows"], p["first_id"], p["last_id"]) for p in pages] == [
        (len(c), c[0], c[-1]) for c in chunks
    ]
    assert [p["next_cursor"] is None for p in pages] == [False] * (len(chunks) - 1) + [True]
    if len(chunks) > 1:
        page = fetch_page(tied, {"limit": "10", "cursor": pages[0]["next_cursor"]})
        assert ids(page) == order[limit:limit + 10]


def test_page_index_of_nothing(tied):
    assert page_index(tied, LogFilter(service="none"), 10).collect() == []


def test_cursor_columns(tied):
    token = encode_cursor(F.col("timestamp"), F.col("id"))
    back = tied.select("timestamp", "id", decode_cursor(token).alias("p"))
    assert back.filter("p.timestamp = timestamp and p.id = id").count() == 1200


@pytest.mark.parametrize("payload, valid", [
    ('{"v":1,"ts":"2031-03-09T04:17:22.081Z","id":"9223372036854775807"}', True),
    ('{"v":2,"ts":"2031-03-09T04:17:22.081Z","id":"1"}', False),
    ('{"v":"1","ts":"2031-03-09T04:17:22.081Z","id":"1"}', False),
    ('{"v":1,"ts":"never","id":"1"}', False),
    ('{"v":1,"ts":"2031-03-09T04:17:22.081Z","id":1}', False),
    ('{"v":1,"ts":"2031-03-09T04:17:22.081Z","id":"-1"}', False),
    ('{"v":1,"ts":"2031-03-09T04:17:22.081Z","id":"12345678901234567890"}', False),
    ('{"v":1,"ts":"2031-03-09T04:17:22.081Z","id":"1"}],[', False),
    ("[]", False), ("null", False), ("", False),
])
def test_cursor_column_rules(spark, payload, valid):
    token = base64.urlsafe_b64encode(payload.encode()).decode().rstrip("=")
    (got,) = spark.createDataFrame([(token,)], "t string").select(decode_cursor(F.col("t"))).first()
    assert (got is not None) == valid


def test_busiest_service_ties(spark):
    rows = [row(1, START, service="b"), row(2, START, service="a"),
            row(3, START - timedelta(hours=30), service="z"),
            row(4, START + timedelta(seconds=1), service="z")]
    logs = spark.createDataFrame(rows, STORED_LOG)
    end = text_millis("2031-05-03T14:00:00Z")
    assert busiest_service(logs, end, 24).first()["service"] == "a"
    assert busiest_service(logs, end, 48).first()["service"] == "z"
    assert busiest_service(logs, end + 1, 48).first()["count"] == 2


def test_discover(spark):
    rows = [row(1, START, message="old"),
            row(2, START, message="a  of (long!) word", zz="1", b="2", aa="3")]
    found = discover(spark.createDataFrame(rows, STORED_LOG)).first()
    assert (found["attr_key"], found["attr_value"], found["word"]) == ("b", "2", "long")
    assert found["end"] == "2031-05-03T14:00:00.000Z"


def test_discover_names_the_busiest_service_of_the_window(spark):
    rows = [row(1, START, service="once"), row(2, START - timedelta(hours=1), service="often"),
            row(3, START - timedelta(hours=2), service="often"),
            *[row(4 + i, START - timedelta(hours=40), service="before") for i in range(5)]]
    logs = spark.createDataFrame(rows, STORED_LOG)
    assert discover(logs).first()["service"] == "often"
    assert discover(logs, 48).first()["service"] == "before"
    early = discover(logs, 24, until="2031-05-02T00:00:00Z").first()
    assert (early["service"], early["end"]) == ("before", "2031-05-02T00:00:00.000Z")
    assert discover(logs, 24, until="2020-01-01T00:00:00Z").first() is None
    assert discover(logs.limit(0)).first() is None
    with pytest.raises(ValueError, match="invalid until"):
        discover(logs, until="soon")


def test_short_rest_of_a_word_is_nothing(spark):
    logs = spark.createDataFrame([row(1, START, message="--a-- word")], STORED_LOG)
    assert discover(logs).first()["word"] is None


def test_day_and_row_filters_reach_the_scan(spark, series, tmp_path):
    path = str(tmp_path / "logs")
    series.write.partitionBy("event_date").parquet(path)
    logs = spark.read.schema(STORED_LOG).parquet(path)
    wanted = parse_filter({"since": SINCE, "until": UNTIL, "service": "mill", "level": "error"})
    rows = filter_logs(logs, wanted).filter(after_cursor(logs, (text_millis(SINCE), 5)))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = rows.select("id")._jdf.queryExecution().executedPlan().toString()
    partition = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    pushed = plan[plan.index("PushedFilters"):]
    assert "event_date" in partition
    for part in ("GreaterThanOrEqual(timestamp", "LessThan(timestamp", "EqualTo(service,mill)",
                 "EqualTo(level,3)", "Or(LessThan(timestamp", "LessThan(id,5)"):
        assert part in pushed
    assert "message" not in plan[plan.index("ReadSchema"):]
