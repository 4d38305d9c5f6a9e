"""Summaries of request samples: latency, outcomes, rates, verdicts.

Samples have the columns of ``schema.REQUEST_SAMPLE``. A request without a
response has no latency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.operators.percentiles import exact_percentiles, nearest_rank
from emberlog.schema import DAY_MS

# Reported percentiles and targets.
PERCENTS = {"p50": 50, "p90": 90, "p95": 95, "p99": 99}
LATENCY_TARGET_MS = 1_000
FRESHNESS_TARGET_MS = 20_000
RATE_SHARE = 0.95
END_PAGES = 10
FLAT_RATIO = 2

OK, REJECTED, THROTTLED = 200, 400, 429


def _responded(status: int | None = None) -> Column:
    answered = F.col("network_ok")
    return answered if status is None else answered & (F.col("status") == status)


def _failed() -> Column:
    return ~F.col("network_ok") | ~F.col("status").isin(OK, REJECTED, THROTTLED)


def latency_summary(samples: DataFrame) -> DataFrame:
    """``(pooled, shape, requests, count, min, mean, p50, p90, p95, p99, max,
    errors)`` per shape and over all shapes; no responses give count 0 and nulls.
    """
    # A missing shape is a shape of its own, apart from an empty one.
    timed = samples.select(
        F.coalesce(F.concat(F.lit("="), "shape"), F.lit("")).alias("shape"),
        F.when(_responded(), F.col("elapsed_ms")).alias("latency"),
        (~F.col("network_ok") | (F.col("status") != OK)).alias("error"),
    )
    figures = timed.rollup("shape").agg(
        (F.grouping("shape") == 1).alias("pooled"),
        F.count("*").alias("requests"),
        F.count("latency").alias("count"),
        F.min("latency").alias("min"),
        F.avg("latency").alias("mean"),
        F.max("latency").alias("max"),
        F.count_if("error").alias("errors"),
    )
    figures = figures.withColumn("shape", F.coalesce("shape", F.lit("")))
    # Every sample counts for its shape and for the pool; the counting of equal
    # latencies inside ``exact_percentiles`` combines both before the shuffle.
    scopes = F.explode(F.array(
        F.struct(F.lit(False).alias("pooled"), F.col("shape").alias("scope")),
        F.struct(F.lit(True).alias("pooled"), F.lit("").alias("scope")),
    ))
    scoped = timed.select(scopes.alias("s"), "latency").select(
        F.col("s.pooled"), F.col("s.scope").alias("shape"), "latency"
    )
    ranked = exact_percentiles(scoped, "latency", PERCENTS, ["pooled", "shape"])
    return figures.join(ranked, ["pooled", "shape"], "left").select(
        "pooled",
        F.when(~F.col("pooled") & (F.col("shape") != ""), F.substring("shape", 2, 1 << 30)).alias("shape"),
        "requests", "count", "min", "mean", *PERCENTS, "max", "errors",
    )


def worst_shape(summary: DataFrame, target_ms: float = LATENCY_TARGET_MS) -> DataFrame:
    """The shape with the highest p95 and whether every shape meets the target.

    Equal p95 go to the smaller name. Takes the rows of ``latency_summary``.
    """
    worst = F.min_by(
        F.struct("shape", "p95"),
        F.when(~F.col("pooled") & (F.col("count") > 0), F.struct(-F.col("p95"), F.col("shape"))),
    )
    overall = summary.agg(
        worst.alias("worst"),
        F.max(F.when(F.col("pooled"), F.col("requests"))).alias("requests"),
        F.max(F.when(F.col("pooled"), F.col("errors"))).alias("errors"),
        F.max(F.when(F.col("pooled"), F.col("p95"))).alias("overall_p95"),
        F.count_if(~F.col("pooled") & (F.col("p95") > target_ms)).alias("over_target"),
    )
    passed = (F.col("worst.p95") < target_ms) & (F.col("errors") == 0)
    return overall.select(
        F.col("worst.shape").alias("shape"),
        F.col("worst.p95").alias("p95"),
        "overall_p95", "requests", "errors", "over_target",
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def outcomes(samples: DataFrame, *by: str) -> DataFrame:
    """Requests by what became of them, and latency samples they left."""
    return samples.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.count_if(_responded(OK)).alias("ok"),
        F.count_if(_responded(REJECTED)).alias("rejected"),
        F.count_if(_responded(THROTTLED)).alias("throttled"),
        F.count_if(_failed()).alias("failed"),
        F.count_if(~F.col("network_ok")).alias("network_failures"),
        F.count_if(_responded()).alias("latency_samples"),
    )


def throughput(samples: DataFrame, *by: str) -> DataFrame:
    """Rates over the wall time from the first start to the last end."""
    started = F.unix_micros(F.col("started_at").cast("timestamp")) / 1_000
    totals = samples.groupBy(*by).agg(
        ((F.max(started + F.col("elapsed_ms")) - F.min(started)) / 1_000).alias("seconds"),
        F.count("*").alias("requests"),
        F.sum("sent").alias("sent"),
        F.sum(F.when(_responded(OK), F.col("accepted")).otherwise(0)).alias("accepted"),
        F.sum("bytes").alias("bytes"),
        F.count_if(_responded(THROTTLED) | _failed()).alias("dropped"),
    )
    seconds = F.nullif(F.col("seconds"), F.lit(0.0))
    return totals.select(
        *by, "seconds", "requests", "sent", "accepted", "bytes", "dropped",
        (F.col("sent") / seconds).alias("sent_per_sec"),
        (F.col("accepted") / seconds).alias("accepted_per_sec"),
        (F.col("requests") / seconds).alias("requests_per_sec"),
    )


def calendar(first_and_last: DataFrame, width: int) -> DataFrame:
    """``millis`` of every interval from a first to a last one (one row ``first, last``).

    The days between are laid out over all tasks, and each day makes its own intervals.
    """
    day = F.explode(F.sequence(F.floor(F.col("first") / DAY_MS), F.floor(F.col("last") / DAY_MS)))
    days = first_and_last.where(F.col("first").isNotNull()).select("first", "last", day.alias("day"))
    start = F.col("day") * DAY_MS
    inside = F.sequence(start + F.pmod(-start, F.lit(width)), start + DAY_MS - 1, F.lit(width).cast("bigint"))
    # An interval wider than a day begins on few days.
    begins = F.pmod(-start, F.lit(width)) < DAY_MS
    return (
        days.repartition("day").where(begins)
        .select("first", "last", F.explode(inside).alias("millis"))
        .where(F.col("millis").between(F.col("first"), F.col("last"))).select("millis")
    )


def interval_rate(samples: DataFrame, seconds: int = 1, every: bool = False) -> DataFrame:
    """Accepted rate per interval with running totals, in time order.

    With ``every`` there is also a row for each interval without requests between the
    first and the last one; its totals are those before it. The running totals are
    summed inside each day and then shifted by the totals of all earlier days, so no
    task holds more than one day of intervals.
    """
    width = seconds * 1_000
    started = F.unix_millis(F.col("started_at").cast("timestamp"))
    timed = samples.filter(F.col("started_at").isNotNull())
    intervals = timed.groupBy((started - F.pmod(started, F.lit(width))).alias("millis")).agg(
        F.sum(F.when(_responded(OK), F.col("accepted")).otherwise(0)).alias("accepted"),
        F.count("*").alias("requests"),
        F.count_if(_responded(THROTTLED)).alias("throttled"),
        F.count_if(_failed()).alias("failed"),
    )
    sums = ["accepted", "requests", "throttled", "failed"]
    if every:
        ends = intervals.agg(F.min("millis").alias("first"), F.max("millis").alias("last"))
        intervals = calendar(ends, width).join(intervals, "millis", "left").select(
            "millis", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums]
        )
    # Never null, so the join below adds no filter to one side only and both
    # sides share one scan.
    day = F.coalesce(F.floor(F.col("millis") / DAY_MS), F.lit(0))
    intervals = intervals.withColumn("day", day)
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = intervals.groupBy("day").agg(*[F.sum(c).alias(c) for c in sums]).select(
        "day", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums]
    )
    today = Window.partitionBy("day").orderBy("millis")
    return (
        intervals.join(days, "day")
        .select(
            F.timestamp_millis("millis").alias("interval_start"),
            F.col("accepted"),
            (F.col("accepted") / seconds).alias("rate"),
            *[
                (F.sum(c).over(today) + F.col(f"{c}_before")).alias(f"total_{c}")
                for c in sums
            ],
        )
        .orderBy("interval_start")
    )


def achieved_rate(samples: DataFrame, offered_per_sec: float, *by: str) -> DataFrame:
    """Requests per second over the driver's own window, against the offered rate."""
    started = F.unix_micros(F.col("started_at").cast("timestamp"))
    window = ((F.max(started) - F.min(started)) / 1_000_000).alias("seconds")
    counted = samples.groupBy(*by).agg(F.count("*").alias("requests"), window)
    rate = F.col("requests") / F.nullif(F.col("seconds"), F.lit(0.0))
    rated = counted.select(*by, "requests", "seconds", rate.alias("rate"))
    passed = F.col("rate") >= offered_per_sec * RATE_SHARE
    return rated.withColumn("passed", F.coalesce(passed, F.lit(False)))


def average_rows(samples: DataFrame, *by: str) -> DataFrame:
    """Rows per request answered with 200, 0 when there was none."""
    counted = samples.groupBy(*by).agg(
        F.count_if(_responded(OK)).alias("ok"),
        F.sum(F.when(_responded(OK), F.col("rows")).otherwise(0)).alias("rows"),
    )
    average = F.col("rows") / F.nullif(F.col("ok"), F.lit(0))
    return counted.withColumn("avg_rows", F.coalesce(average, F.lit(0.0)))


def depth_ratio(pages: DataFrame) -> DataFrame:
    """Whether deep pages cost more than the first ones.

    ``pages`` has ``page`` numbered from 1, ``elapsed_ms`` and ``rows``. A tenth
    of the pages, 1 to 10 of them, is compared at both ends.
    """
    # Only the 10 outermost pages of each end are kept, so the window below
    # sees at most 20 rows.
    head = pages.orderBy(F.asc("page")).limit(END_PAGES).withColumn("segment", F.lit("first"))
    tail = pages.orderBy(F.desc("page")).limit(END_PAGES).withColumn("segment", F.lit("last"))
    depth = F.max("page").over(
        Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    ends = head.unionByName(tail).withColumn("depth", depth)
    compared = F.least(F.lit(END_PAGES), F.greatest(F.lit(1), F.floor(F.col("depth") / 10)))
    place = F.when(F.col("segment") == "first", F.col("page")).otherwise(
        F.col("depth") - F.col("page") + 1
    )
    latencies = F.array_sort(F.collect_list("elapsed_ms"))
    segments = ends.filter(place <= compared).groupBy("segment").agg(
        F.count("*").alias("pages"), F.sum("rows").alias("rows"), latencies.alias("latencies")
    )

    def percentile(percent: float) -> Column:
        place = nearest_rank(percent, F.size("latencies")).cast("int")
        return F.element_at("latencies", place)

    segments = segments.select(
        "segment", "pages", "rows", percentile(50).alias("p50"),
        percentile(95).alias("p95"), F.array_max("latencies").alias("max"),
    )
    everything = pages.withColumn("segment", F.lit("all"))
    whole = everything.groupBy("segment").agg(
        F.count("*").alias("pages"), F.sum("rows").alias("rows"), F.max("elapsed_ms").alias("max")
    )
    ranked = exact_percentiles(everything, "elapsed_ms", {"p50": 50, "p95": 95}, ["segment"])
    rows = segments.unionByName(whole.join(ranked, "segment"))
    # Three rows: both ends and the whole.
    every = Window.orderBy("segment").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    first = F.max(F.when(F.col("segment") == "first", F.col("p50"))).over(every)
    last = F.max(F.when(F.col("segment") == "last", F.col("p50"))).over(every)
    ratio = F.when(first > 0, last / first)
    return (
        rows.withColumn("ratio", ratio)
        .withColumn("flat", F.coalesce(F.col("ratio") < FLAT_RATIO, F.lit(False)))
        .select("segment", "pages", "rows", "p50", "p95", "max", "ratio", "flat")
    )


def freshness_probes(acknowledgements: DataFrame) -> DataFrame:
    """Time from arrival to readable, per acknowledged batch."""
    waited = (
        F.unix_micros("committed_at") - F.unix_micros("received_at")
    ) / 1_000
    return acknowledgements.select("batch_id", waited.alias("elapsed_ms"))


def freshness(probes: DataFrame, target_ms: float = FRESHNESS_TARGET_MS) -> DataFrame:
    """Summary of the probes readable in time; the others count as timeouts."""
    visible = F.col("elapsed_ms") < target_ms
    scoped = probes.select(
        F.lit("all").alias("scope"), F.when(visible, F.col("elapsed_ms")).alias("latency"),
    )
    figures = scoped.groupBy("scope").agg(
        F.count("*").alias("probes"),
        F.count("latency").alias("visible"),
        F.min("latency").alias("min"),
        F.max("latency").alias("max"),
    )
    ranked = exact_percentiles(scoped, "latency", {"p50": 50, "p95": 95}, ["scope"])
    timeouts = F.col("probes") - F.col("visible")
    return figures.join(ranked, "scope", "left").select(
        "probes", "visible", timeouts.alias("timeouts"), "min", "p50", "p95", "max",
        ((F.col("visible") > 0) & (timeouts == 0)).alias("passed"),
    )
