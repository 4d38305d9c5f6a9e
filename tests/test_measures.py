"""Measurement jobs against plain Python on small samples."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest

from emberlog.operators import measures
from emberlog.operators.percentiles import exact_percentiles
from emberlog.schema import REQUEST_SAMPLE

START = datetime(2031, 8, 11, 23, 59, 50)


def nearest(values, percent):
    ordered = sorted(values)
    return ordered[min(len(ordered), max(1, math.ceil(percent / 100 * len(ordered)))) - 1]


@pytest.fixture(scope="module")
def raw():
    draw = random.Random(5)
    rows = []
    for seq in range(900):
        shape = "hot" if seq % 3 == 0 else f"s{draw.randrange(4)}"
        status = draw.choice([200, 200, 200, 400, 429, 500])
        rows.append((
            "load", shape, seq, START + timedelta(milliseconds=seq * 37),
            draw.choice([draw.expovariate(0.02), 5.0, 0.1]), seq % 40 != 0, status,
            draw.randrange(100), 500, 480 if status == 200 else 0, 1_000,
        ))
    rows.append(("load", "silent", 900, START, 9.0, False, 0, 0, 500, 0, 1_000))
    return rows


@pytest.fixture(scope="module")
def samples(spark, raw):
    return spark.createDataFrame(raw, REQUEST_SAMPLE).repartition(5)


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], [5.0] * 1000, list(map(float, range(1, 101))),
    [random.Random(1).gauss(0, 1e4) for _ in range(500)],
    [1e-9, 2e-9, 3e-9, 1e300, -1e300, 0.0, -1e-9], [1e-9 * i for i in range(50)],
    [1.7e15 + i * 0.25 for i in range(3000)],
])
def test_percentiles_equal_sorting(spark, values):
    frame = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    percents = {"p0": 0, "p1": 1, "p50": 50, "p95": 95, "p99": 99, "p100": 100}
    (got,) = exact_percentiles(frame, "v", percents, ["g"]).collect()
    assert {n: got[n] for n in percents} == {n: nearest(values, p) for n, p in percents.items()}


def test_latency_summary(samples, raw):
    got = {r["shape"]: r for r in measures.latency_summary(samples).collect()}
    assert set(got) == {r[1] for r in raw} | {None}
    for shape, row in got.items():
        mine = [r for r in raw if shape in (None, r[1])]
        times = [r[4] for r in mine if r[5]]
        assert row["pooled"] == (shape is None)
        assert (row["requests"], row["count"]) == (len(mine), len(times))
        assert row["errors"] == sum(1 for r in mine if not r[5] or r[6] != 200)
        if not times:
            assert row["min"] is row["mean"] is row["p50"] is row["max"] is None
            continue
        assert (row["min"], row["max"]) == (min(times), max(times))
        assert row["mean"] == pytest.approx(sum(times) / len(times))
        for name, percent in measures.PERCENTS.items():
            assert row[name] == nearest(times, percent)


def test_worst_shape(spark, samples, raw):
    summary = measures.latency_summary(samples)
    p95 = {s: nearest([r[4] for r in raw if r[1] == s and r[5]], 95)
           for s in {r[1] for r in raw} - {"silent"}}
    worst = min(p95, key=lambda s: (-p95[s], s))
    got = measures.worst_shape(summary).first()
    assert (got["shape"], got["p95"], got["passed"]) == (worst, p95[worst], False)
    good = spark.createDataFrame(
        [("load", s, 1, START, 7.0, True, 200, 1, 1, 1, 1) for s in ("b", "a")], REQUEST_SAMPLE
    )
    got = measures.worst_shape(measures.latency_summary(good)).first()
    assert (got["shape"], got["passed"], got["over_target"]) == ("a", True, 0)


def test_outcomes_and_throughput(samples, raw):
    got = measures.outcomes(samples).first()
    answered = [r for r in raw if r[5]]
    status = {s: sum(1 for r in answered if r[6] == s) for s in (200, 400, 429, 500)}
    silent = len(raw) - len(answered)
    assert got.asDict() == {
        "requests": len(raw), "ok": status[200], "rejected": status[400],
        "throttled": status[429], "failed": status[500] + silent, "network_failures": silent,
        "latency_samples": len(answered),
    }
    rate = measures.throughput(samples).first()
    accepted = sum(r[9] for r in answered)
    seconds = max((r[3] - START).total_seconds() + r[4] / 1000 for r in raw)
    assert rate["seconds"] == pytest.approx(seconds, abs=1e-5)
    assert rate["accepted"] == accepted
    assert rate["dropped"] == status[429] + status[500] + silent
    assert rate["accepted_per_sec"] == pytest.approx(accepted / seconds, rel=1e-5)


def test_interval_rate_runs_over_midnight(samples, raw):
    rows = measures.interval_rate(samples).collect()
    total = 0
    for row in rows:
        start = row["interval_start"]
        mine = [r for r in raw if start <= r[3] < start + timedelta(seconds=1)]
        accepted = sum(r[9] for r in mine if r[5])
        total += accepted
        assert (row["accepted"], row["rate"], row["total_accepted"]) == (accepted, accepted, total)
    assert rows[-1]["total_requests"] == len(raw)
    assert {r["interval_start"].day for r in rows} == {11, 12}


def test_achieved_rate_and_average_rows(samples, raw):
    got = measures.achieved_rate(samples, 27).first()
    assert got["rate"] == pytest.approx(901 / (899 * 0.037)) and got["passed"]
    assert not measures.achieved_rate(samples, 40).first()["passed"]
    rows = {r["shape"]: r["avg_rows"] for r in measures.average_rows(samples, "shape").collect()}
    assert rows["silent"] == 0
    ok = [r[7] for r in raw if r[1] == "hot" and r[5] and r[6] == 200]
    assert rows["hot"] == pytest.approx(sum(ok) / len(ok))


@pytest.mark.parametrize("depth", [1, 5, 19, 20, 100, 250])
def test_depth_ratio(spark, depth):
    times = [float(10 + (i * 7) % 13 + (i > depth / 2) * 20) for i in range(depth)]
    pages = spark.createDataFrame(
        [(i + 1, times[i], 100) for i in range(depth)], "page long, elapsed_ms double, rows int"
    )
    ends = min(10, max(1, depth // 10))
    got = {r["segment"]: r for r in measures.depth_ratio(pages).collect()}
    for name, part in (("first", times[:ends]), ("last", times[-ends:]), ("all", times)):
        row = got[name]
        assert (row["pages"], row["rows"]) == (len(part), 100 * len(part))
        assert (row["p50"], row["p95"], row["max"]) == (
            nearest(part, 50), nearest(part, 95), max(part)
        )
        ratio = nearest(times[-ends:], 50) / nearest(times[:ends], 50)
        assert row["ratio"] == pytest.approx(ratio) and row["flat"] == (ratio < 2)


def test_freshness(spark):
    probes = spark.createDataFrame([(t,) for t in (100.0, 300.0, 200.0)], "elapsed_ms double")
    got = measures.freshness(probes).first()
    assert (got["visible"], got["timeouts"], got["p50"], got["max"]) == (3, 0, 200.0, 300.0)
    assert got["passed"]
    late = probes.union(spark.createDataFrame([(20_000.0,)], "elapsed_ms double"))
    got = measures.freshness(late).first()
    assert (got["visible"], got["timeouts"], got["max"], got["passed"]) == (3, 1, 300.0, False)


@pytest.mark.parametrize("seconds", [1, 7, 3600, 100_000])
def test_every_interval_has_a_row_also_over_an_empty_day(spark, seconds):
    start = datetime(2031, 3, 1, 23, 59, 50)
    kind = "started_at timestamp, network_ok boolean, status int, accepted int"
    moments = [(0, 5), (3, 2), (3, 1), (20, 4), (2 * 86_400 + 11, 7)] if seconds > 1 else [(0, 5), (3, 2), (3, 1), (20, 4)]
    rows = [(start + timedelta(seconds=s), True, 200, n) for s, n in moments] + [(None, True, 200, 9)]
    found = measures.interval_rate(spark.createDataFrame(rows, kind).repartition(3), seconds, every=True).collect()
    epoch = [int(r["interval_start"].replace(tzinfo=timezone.utc).timestamp()) for r in found]
    base = int(start.replace(tzinfo=timezone.utc).timestamp())
    want = sorted({(base + s) // seconds * seconds for s, _ in moments})
    assert epoch == list(range(want[0], want[-1] + 1, seconds))
    for at, row in zip(epoch, found, strict=True):
        inside = [n for s, n in moments if at <= base + s < at + seconds]
        before = [n for s, n in moments if base + s < at + seconds]
        assert (row["accepted"], row["total_accepted"], row["total_requests"]) == (sum(inside), sum(before), len(before))
    nothing = spark.createDataFrame([], kind)
    assert measures.interval_rate(nothing, seconds, every=True).collect() == []
