"""The given tables seen as logs, raw batches and request samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.arguments import parse_filter
from emberlog.functions.levels import decode_level
from emberlog.functions.times import iso_text, millis_literal, millis_text, text_millis
from emberlog.operators.validation import FIELDS
from emberlog.session import configure

RECEIVED_AT = "2024-01-31T00:00:00.000Z"
BATCH_EVENTS = 100
ENTRY_CASES = 47
ENVELOPE_CASES = 29


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_logs(
    spark: SparkSession,
    sf_dir: str,
    arguments: Mapping[str, object] | None = None,
    unit: str = "MILLISECOND",
) -> DataFrame:
    """Events as logs, times cut to ``unit``.

    The time bounds of a query are whole milliseconds, so they hold for the
    stored column exactly when they hold for the cut one; put on the stored
    column they reach the Parquet reader.
    """
    events = table(spark, sf_dir, "events")
    wanted = parse_filter(arguments or {})
    stored = events.schema["ts"].dataType
    if unit == "MILLISECOND" and wanted.since is not None:
        events = events.filter(F.col("ts") >= millis_literal(wanted.since, stored))
    if unit == "MILLISECOND" and wanted.until is not None:
        events = events.filter(F.col("ts") < millis_literal(wanted.until, stored))
    return events.select(
        F.col("event_id").alias("id"),
        F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("timestamp"),
        (F.col("user_id") % 4).cast("smallint").alias("level"),
        F.col("event_type").alias("service"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string"))
        .alias("message"),
        F.create_map(
            F.lit("k"), F.get_json_object("props", "$.k"),
            F.lit("user_id"), F.col("user_id").cast("string"),
        ).alias("attributes"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs: the text is the message, 37 seconds apart."""
    start = text_millis("2024-01-01T00:00:00Z")
    moment = F.timestamp_millis(F.lit(start) + F.col("doc_id") * 37_000)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        moment.cast("timestamp_ntz").alias("timestamp"),
        (F.col("doc_id") % 4).cast("smallint").alias("level"),
        F.col("source").alias("service"),
        F.col("text").alias("message"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("attributes"),
    )


def document_end(spark: SparkSession, sf_dir: str) -> str:
    """A time just after the last document."""
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    return millis_text(text_millis("2024-01-01T00:00:00Z") + last * 37_000 + 1)


def shipment_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as logs in bulk, by day of shipment."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_shipdate").alias("timestamp"),
        (F.col("l_linenumber") % 4).cast("smallint").alias("level"),
        F.concat("l_returnflag", "l_linestatus").alias("service"),
        F.concat_ws(" ", F.col("l_partkey").cast("string"), "l_returnflag").alias("message"),
        F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("attributes"),
    )


def _cases(case: Column, usual: Column, unusual: Mapping[int, str | None]) -> Column:
    value = usual
    for number, text in unusual.items():
        value = F.when(case == number, F.lit(text).cast("string")).otherwise(value)
    return value


# Per field, the JSON text of chosen entries by ``event_id % 47``; None leaves
# the field out. Each breaks one rule or takes one unusual but valid form.
BROKEN_FIELDS: dict[str, dict[int, str | None]] = {
    "timestamp": {
        2: None,
        3: "1704067200",
        4: '"yesterday"',
        5: '"2024-13-01T00:00:00Z"',
        6: '"2024-01-31T00:05:00.001Z"',
        7: '"2023-12-31T23:59:59.999Z"',
        27: '"2024-01-15T12:00:00.5+02:00"',
        28: '"2024-01-05T24:00:00Z"',
        30: '"2024-01-30T23:59:59.1239+0530"',
    },
    "level": {8: '"critical"', 9: None, 10: '{"a":1}', 11: "2"},
    "service": {12: '""', 13: None},
    "message": {14: None, 15: '""'},
    "attributes": {
        16: '"x"',
        17: "null",
        18: "{" + ",".join(f'"k{i}":{i}' for i in range(65)) + "}",
        19: '{"":1}',
        20: '{"' + "k" * 129 + '":1}',
        21: '{"a":null}',
        22: '{"a":{"b":1}}',
        23: '{"a":1e400}',
        24: '{"a":"' + "v" * 1025 + '"}',
        25: None,
        26: '{"n":1.50,"m":1e5,"s":1e21,"t":1e-7}',
        29: '{"a":"x","a":"y"}',
    },
}


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed 100 to an envelope, chosen entries and envelopes broken.

    The narrow rows move to their batch first, so the texts are written and later
    parsed by all tasks; the grouping needs no further shuffle.
    """
    batch = F.floor(F.col("id") / BATCH_EVENTS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    logs = event_logs(spark, sf_dir).withColumn("batch", batch).repartition(tasks, "batch")
    case = F.col("id") % ENTRY_CASES
    user = F.col("attributes")["user_id"]
    usual = {
        "timestamp": F.concat(F.lit('"'), iso_text(F.col("timestamp")), F.lit('"')),
        "level": F.concat(F.lit('"'), decode_level(F.col("level")), F.lit('"')),
        "service": F.concat(F.lit('"'), "service", F.lit('"')),
        "message": F.when(
            F.col("id") % (ENTRY_CASES * 10) == 15,
            F.concat(F.lit('"'), F.repeat(F.lit("x"), 65_537), F.lit('"')),
        ).otherwise(
            _cases(case, F.concat(F.lit('"'), "message", F.lit('"')), BROKEN_FIELDS["message"])
        ),
        "attributes": F.concat(
            F.lit('{"k":'), F.col("attributes")["k"], F.lit(',"user_id":"'), user,
            F.lit('","ok":true}'),
        ),
    }
    fields = []
    for name in FIELDS:
        value = usual[name]
        if name != "message":
            value = _cases(case, value, BROKEN_FIELDS[name])
        fields.append(F.concat(F.lit(f'"{name}":'), value))
    entry = _cases(
        case, F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")), {0: "42", 1: '["a"]'}
    )
    packed = (
        logs.select("id", "batch", entry.alias("entry"))
        .groupBy("batch")
        .agg(F.array_sort(F.collect_list(F.struct("id", "entry"))).alias("entries"))
    )
    body = F.concat(F.lit('{"logs":['), F.array_join("entries.entry", ","), F.lit("]}"))
    return packed.select(
        F.format_string("batch-%012d", "batch").alias("batch_id"),
        F.lit(RECEIVED_AT).cast("timestamp").alias("received_at"),
        _break_envelope(F.col("batch"), body).alias("body"),
    )


def _break_envelope(batch: Column, body: Column) -> Column:
    case = batch % ENVELOPE_CASES
    zeros = '{"logs":[' + ",".join(["0"] * 5001) + "]}"
    return (
        F.when(batch % (ENVELOPE_CASES * 10) == 19, F.rpad(body, 8 * 1024 * 1024 + 1, " "))
        .when(case == 3, F.substring(body, F.lit(1), F.length(body) - 1))
        .when(case == 5, F.concat(F.lit("["), body, F.lit("]")))
        .when(case == 7, '{"logs":"[1]"}')
        .when(case == 9, '{"entries":[]}')
        .when(case == 11, '{"logs":[]}')
        .when(case == 13, zeros)
        .when(case == 15, F.concat(body, F.lit(" x")))
        .when(case == 17, F.concat(body, F.lit("],[")))
        .when(case == 19, F.concat(F.lit("  "), body, F.lit("\n")))
        .otherwise(body)
    )


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request samples: the type is the shape, the value the latency."""
    statuses = F.array(*[F.lit(status) for status in (200, 200, 400, 429, 500)])
    status = F.element_at(statuses, (F.col("user_id") % 5 + 1).cast("int"))
    ok = status == 200
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("kind"),
        F.col("event_type").alias("shape"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("started_at"),
        F.col("value").alias("elapsed_ms"),
        (F.col("event_id") % 53 != 0).alias("network_ok"),
        status.alias("status"),
        F.when(ok, F.col("user_id") % 101).otherwise(0).cast("int").alias("rows"),
        F.lit(500).alias("sent"),
        F.when(ok, 500 - F.col("event_id") % 7).otherwise(0).cast("int").alias("accepted"),
        (F.col("user_id") + 1_000).alias("bytes"),
    )
