"""Table schemas and the fixed values that every part of the engine shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Severities in ascending order; the stored code is the position.
LEVELS = ("debug", "info", "warn", "error")

# Ingest limits.
MAX_BODY_BYTES = 8 * 1024 * 1024
MAX_BATCH_ENTRIES = 5_000
MAX_MESSAGE_LENGTH = 65_536
MAX_ATTRIBUTES = 64
MAX_ATTRIBUTE_KEY_LENGTH = 128
MAX_ATTRIBUTE_VALUE_LENGTH = 1_024
MAX_FUTURE_SKEW_MS = 5 * 60 * 1_000

# Day-partition window around today.
RETENTION_DAYS = 30
LOOKAHEAD_DAYS = 14

DAY_MS = 86_400_000

# Fixed value: the accepted timestamp shape.
ISO_8601 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})\z"

RAW_BATCH = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("body", T.StringType()),
])

ATTRIBUTES = T.MapType(T.StringType(), T.StringType(), valueContainsNull=False)

LOG_ROW = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("level", T.ShortType()),
    T.StructField("service", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("attributes", ATTRIBUTES),
])

ROW_COLUMNS = tuple(LOG_ROW.fieldNames())

# The stored form: row columns first, folder columns last.
STORED_LOG = T.StructType([
    *LOG_ROW.fields,
    T.StructField("event_date", T.DateType()),
    T.StructField("ingest_batch", T.StringType()),
])

# Rows per minute, service and level; the time is the start of the minute.
MINUTE_COUNT = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("level", T.ShortType()),
    T.StructField("service", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("ingest_batch", T.StringType()),
])

REJECTED = T.ArrayType(
    T.StructType([
        T.StructField("index", T.IntegerType()),
        T.StructField("reason", T.StringType()),
    ])
)

ACKNOWLEDGEMENT = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("accepted", T.LongType()),
    T.StructField("rejected", REJECTED),
    T.StructField("committed_at", T.TimestampType()),
])

REQUEST_SAMPLE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("shape", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("elapsed_ms", T.DoubleType()),
    T.StructField("network_ok", T.BooleanType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("rows", T.IntegerType()),
    T.StructField("sent", T.IntegerType()),
    T.StructField("accepted", T.IntegerType()),
    T.StructField("bytes", T.LongType()),
])
