"""Every query over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.arguments import LogFilter, parse_filter
from emberlog.functions.cursors import decode_cursor, encode_cursor, token_of
from emberlog.functions.levels import decode_level, encode_level, severity_at_least
from emberlog.functions.texts import first_long_word
from emberlog.functions.times import iso_millis, iso_text, text_millis
from emberlog.operators import maintenance, measures
from emberlog.operators.acknowledge import acknowledge
from emberlog.operators.buckets import busiest_service, count_by_bucket, totals_by_width
from emberlog.operators.discovery import describe_rows, discover
from emberlog.operators.ingest import ingest
from emberlog.operators.listing import fetch_page, list_page, newest_row, output_columns
from emberlog.operators.maintenance import compact_day, purge_replaced, run_maintenance
from emberlog.operators.pages import page_index
from emberlog.operators.rollup import count_table
from emberlog.operators.totals import day_totals
from emberlog.operators.validation import judge_batches, rejected_entries
from emberlog.plans import views
from emberlog.session import configure, scratch_dir
from emberlog.sources.batches import read_batch_table
from emberlog.sources.log_table import (
    LogTable,
    log_days,
    read_acknowledgements,
    read_logs,
    read_rejected,
)
from emberlog.streaming.freshness import probe_stream
from emberlog.streaming.ingest import start_ingest, stop_when_drained

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"

EVENT_LOGS = """
logs AS (
  SELECT event_id AS id, date_trunc('milliseconds', ts) AS t, user_id % 4 AS lv,
         event_type AS service, event_type || ' by user ' || user_id AS message,
         json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS u
  FROM events)
"""

DOCUMENT_LOGS = """
logs AS (
  SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 37) AS t, doc_id % 4 AS lv,
         source AS service, text AS message, lang
  FROM documents)
"""

LEVEL = "CASE lv WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warn' WHEN 3 THEN 'error' END"
EVENT_ATTRIBUTES = "'k=' || k || ',user_id=' || u"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def attribute_text(column: str = "attributes") -> Column:
    """A map as ``key=value`` texts in key order, equal on every engine."""
    pairs = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ",")


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("attributes", attribute_text())


def bucket_rows(counted: DataFrame) -> DataFrame:
    return counted.select(iso_text(F.col("start")).alias("start"), "group", "count")


def bucket_sql(
    source: str, where: str, width: str, origin: str, group: str = ""
) -> str:
    start = f"strftime(time_bucket(INTERVAL '{width}', t, TIMESTAMP '{origin}'), {ISO})"
    label = group or "CAST(NULL AS VARCHAR)"
    return (
        f"WITH {source} SELECT {start} AS start, {label} AS \"group\", count(*) AS count "
        f"FROM logs WHERE {where} GROUP BY 1, 2 ORDER BY 1, 2"
    )


# ---------------------------------------------------------------- bucket counts

JANUARY = {"since": "2024-01-01T00:00:00Z", "until": "2024-01-31T00:00:00Z"}
IN_JANUARY = "t >= TIMESTAMP '2024-01-01' AND t < TIMESTAMP '2024-01-31'"
ODD_RANGE = {"since": "2024-01-02T00:07:30.250Z", "until": "2024-01-28T11:00:00+02:00"}
IN_ODD_RANGE = (
    "t >= TIMESTAMP '2024-01-02 00:07:30.250' AND t < TIMESTAMP '2024-01-28 09:00:00'"
)
ODD_ORIGIN = "2024-01-02 00:07:30.250"


def event_buckets(spark: SparkSession, sf_dir: str, **arguments: str) -> DataFrame:
    logs = views.event_logs(spark, sf_dir, arguments)
    return bucket_rows(count_by_bucket(logs, arguments))


@query(bucket_sql(EVENT_LOGS, IN_ODD_RANGE, "1 hour", ODD_ORIGIN))
def bucket_count(spark, sf_dir):
    return event_buckets(spark, sf_dir, bucket="1h", **ODD_RANGE)


@query(bucket_sql(EVENT_LOGS, IN_JANUARY, "1 minute", "2024-01-01"))
def bucket_by_minute(spark, sf_dir):
    return event_buckets(spark, sf_dir, bucket="1m", **JANUARY)


@query(bucket_sql(EVENT_LOGS, IN_ODD_RANGE, "5 minutes", ODD_ORIGIN, "service"))
def bucket_by_service(spark, sf_dir):
    return event_buckets(spark, sf_dir, bucket="5m", group_by="service", **ODD_RANGE)


@query(bucket_sql(EVENT_LOGS, IN_ODD_RANGE, "1 hour", ODD_ORIGIN, LEVEL))
def bucket_by_level(spark, sf_dir):
    return event_buckets(spark, sf_dir, bucket="1h", group_by="level", **ODD_RANGE)


@query(bucket_sql(EVENT_LOGS, IN_ODD_RANGE, "24 hours", ODD_ORIGIN, "service"))
def bucket_by_day(spark, sf_dir):
    return event_buckets(spark, sf_dir, bucket="1d", group_by="service", **ODD_RANGE)


@query(bucket_sql(
    EVENT_LOGS,
    IN_ODD_RANGE + " AND service = 'click' AND lv = 3 AND u = '7' AND message ILIKE '%BY USER 7%'",
    "1 hour", ODD_ORIGIN, "service",
))
def bucket_filtered(spark, sf_dir):
    return event_buckets(
        spark, sf_dir, bucket="1h", group_by="service", service="click", level="error",
        q="BY USER 7", **{"attr.user_id": "7"}, **ODD_RANGE,
    )


@query(bucket_sql(DOCUMENT_LOGS, "message ILIKE '%THE%'", "1 hour", "2024-01-01", "service"))
def bucket_substring(spark, sf_dir):
    logs = views.document_logs(spark, sf_dir)
    arguments = {
        "bucket": "1h", "group_by": "service", "q": "THE",
        "since": "2024-01-01T00:00:00Z", "until": views.document_end(spark, sf_dir),
    }
    return bucket_rows(count_by_bucket(logs, arguments))


@query("""
WITH logs AS (SELECT l_shipdate AS t, l_linenumber % 4 AS lv FROM lineitem)
SELECT strftime(time_bucket(INTERVAL '24 hours', t, TIMESTAMP '1995-01-01'), {iso}) AS start,
       {level} AS "group", count(*) AS count
FROM logs WHERE t >= TIMESTAMP '1995-01-01' AND t < TIMESTAMP '2002-01-01' GROUP BY 1, 2
""".format(iso=ISO, level=LEVEL))
def bucket_shipments(spark, sf_dir):
    arguments = {
        "bucket": "1d", "group_by": "level",
        "since": "1995-01-01T00:00:00Z", "until": "2002-01-01T00:00:00Z",
    }
    return bucket_rows(count_by_bucket(views.shipment_logs(spark, sf_dir), arguments))


@query(" UNION ALL ".join(
    f"SELECT '{token}' AS width, count(*) AS buckets, CAST(sum(c) AS BIGINT) AS total FROM ("
    f"SELECT count(*) AS c FROM events WHERE ts >= TIMESTAMP '{ODD_ORIGIN}' "
    f"GROUP BY time_bucket(INTERVAL '{width}', ts, TIMESTAMP '{ODD_ORIGIN}'))"
    for token, width in
    {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "24 hours"}.items()
))
def bucket_widths_total(spark, sf_dir):
    arguments = {"since": ODD_RANGE["since"]}
    logs = views.event_logs(spark, sf_dir, arguments)
    return totals_by_width(logs, parse_filter(arguments))


@query("""
SELECT event_type AS service, count(*) AS count FROM events
WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-30 00:00:01'
GROUP BY 1 ORDER BY 2 DESC, min(time_bucket(INTERVAL '24 hours', ts, TIMESTAMP '2024-01-20')), 1
LIMIT 1
""")
def busiest(spark, sf_dir):
    end = text_millis("2024-01-30T00:00:00Z")
    window = {"since": "2024-01-20T00:00:00Z", "until": "2024-01-30T00:00:01Z"}
    return busiest_service(views.event_logs(spark, sf_dir, window), end, 240)


# ---------------------------------------------------------------------- listing


def list_sql(source: str, attributes: str, where: str, limit: int, cut: str = "t") -> str:
    """A page in output form; the cursor is made from its last row."""
    return f"""
WITH {source},
page AS (SELECT *, {cut} AS moment FROM logs WHERE {where}
         ORDER BY {cut} DESC, id DESC LIMIT {limit + 1}),
placed AS (SELECT *, row_number() OVER (ORDER BY moment DESC, id DESC) AS place,
                  count(*) OVER () AS found FROM page),
tokens AS (SELECT *, '{{"v":1,"ts":"' || strftime(moment, {ISO}) || '","id":"' || id || '"}}' AS raw
           FROM placed)
SELECT CAST(id AS VARCHAR) AS id, strftime(moment, {ISO}) AS "timestamp", {LEVEL} AS level, service,
       message, {attributes} AS attributes,
       CASE WHEN found > {limit} THEN
         (SELECT rtrim(translate(to_base64(encode(raw)), '+/', '-_'), '=')
          FROM tokens WHERE place = {limit}) END AS next_cursor
FROM tokens WHERE place <= {limit}
"""


def event_page(spark: SparkSession, sf_dir: str, **arguments: str) -> DataFrame:
    return shown(list_page(views.event_logs(spark, sf_dir, arguments), arguments))


@query(list_sql(EVENT_LOGS, EVENT_ATTRIBUTES, "true", 100))
def list_newest(spark, sf_dir):
    return event_page(spark, sf_dir)


PAGE_AFTER = token_of(text_millis("2024-01-20T12:00:00Z"), 5_000)


@query(list_sql(
    EVENT_LOGS, EVENT_ATTRIBUTES,
    "t >= TIMESTAMP '2024-01-03' AND (t, id) < (TIMESTAMP '2024-01-20 12:00:00', 5000)", 1000,
))
def list_after_cursor(spark, sf_dir):
    return event_page(
        spark, sf_dir, since="2024-01-03T00:00:00Z", limit="1000", cursor=PAGE_AFTER
    )


TIE_CURSOR = (text_millis("2024-01-20T00:00:00Z"), 6_500)


@query(list_sql(
    EVENT_LOGS, EVENT_ATTRIBUTES,
    "(date_trunc('day', t), id) < (TIMESTAMP '2024-01-20', 6500)", 500, "date_trunc('day', t)",
))
def list_ties(spark, sf_dir):
    arguments = {"limit": "500", "cursor": token_of(*TIE_CURSOR)}
    logs = views.event_logs(spark, sf_dir, unit="DAY")
    return shown(list_page(logs, arguments))


@query(list_sql(EVENT_LOGS, EVENT_ATTRIBUTES, "service = 'error' AND lv = 2", 100))
def list_service_level(spark, sf_dir):
    return event_page(spark, sf_dir, service="error", level="warn")


@query(list_sql(EVENT_LOGS, EVENT_ATTRIBUTES, "k = '5' AND service = 'click'", 1000))
def list_attributes(spark, sf_dir):
    return event_page(spark, sf_dir, service="click", limit="1000", **{"attr.k": "5"})


@query(list_sql(DOCUMENT_LOGS, "'lang=' || lang", "message ILIKE '%data%'", 1000))
def list_substring(spark, sf_dir):
    arguments = {"q": "DATA", "limit": "1000"}
    return shown(list_page(views.document_logs(spark, sf_dir), arguments))


@query(list_sql(DOCUMENT_LOGS, "'lang=' || lang", r"message ILIKE '%\%%' ESCAPE '\'", 1000))
def list_literal_percent(spark, sf_dir):
    arguments = {"q": "%", "limit": "1000"}
    return shown(list_page(views.document_logs(spark, sf_dir), arguments))


@query(f"""
WITH {EVENT_LOGS}
SELECT CAST(id AS VARCHAR) AS id, strftime(t, {ISO}) AS "timestamp", {LEVEL} AS level, service,
       message, {EVENT_ATTRIBUTES} AS attributes
FROM logs WHERE lv >= 2
""")
def severity_from_warn(spark, sf_dir):
    logs = views.event_logs(spark, sf_dir)
    return shown(
        logs.filter(severity_at_least(F.col("level"), "warn")).select(*output_columns())
    )


@query(f"""
WITH {EVENT_LOGS}
SELECT CAST(id AS VARCHAR) AS id, strftime(t, {ISO}) AS "timestamp", {LEVEL} AS level, service,
       message, {EVENT_ATTRIBUTES} AS attributes
FROM logs ORDER BY t DESC, id DESC LIMIT 1
""")
def newest(spark, sf_dir):
    return shown(newest_row(views.event_logs(spark, sf_dir)).select(*output_columns()))


def pages_sql(cut: str, limit: int) -> str:
    return f"""
WITH {EVENT_LOGS},
placed AS (SELECT {cut} AS moment, id, row_number() OVER (ORDER BY {cut} DESC, id DESC) - 1 AS p,
                  count(*) OVER () AS total FROM logs),
pages AS (SELECT p // {limit} + 1 AS page, count(*) AS rows,
                 arg_min(moment, p) AS first_at, arg_min(id, p) AS first_id,
                 arg_max(moment, p) AS last_at, arg_max(id, p) AS last_id,
                 max(p) + 1 < max(total) AS more
          FROM placed GROUP BY 1),
tokens AS (SELECT *, '{{"v":1,"ts":"' || strftime(last_at, {ISO}) || '","id":"' || last_id || '"}}'
             AS raw FROM pages)
SELECT page, rows, strftime(first_at, {ISO}) AS first_timestamp, first_id,
       strftime(last_at, {ISO}) AS last_timestamp, last_id,
       CASE WHEN more THEN rtrim(translate(to_base64(encode(raw)), '+/', '-_'), '=') END
         AS next_cursor
FROM tokens
"""


def page_rows(pages: DataFrame) -> DataFrame:
    return pages.withColumn("first_timestamp", iso_text(F.col("first_timestamp"))).withColumn(
        "last_timestamp", iso_text(F.col("last_timestamp"))
    )


@query(pages_sql("t", 100))
def pages_of_100(spark, sf_dir):
    return page_rows(page_index(views.event_logs(spark, sf_dir), LogFilter(), 100))


@query(pages_sql("date_trunc('month', t)", 30))
def pages_of_ties(spark, sf_dir):
    """Every row has the same time, so ids alone decide the order."""
    logs = views.event_logs(spark, sf_dir, unit="MONTH")
    return page_rows(page_index(logs, LogFilter(), 30))


@query(f"""
WITH {EVENT_LOGS},
raw AS (SELECT id, t, CASE id % 6 WHEN 2 THEN 2 ELSE 1 END AS v,
               CASE id % 6 WHEN 3 THEN 'x' || id ELSE CAST(id AS VARCHAR) END AS text FROM logs),
tokens AS (SELECT id, t, rtrim(translate(to_base64(encode(
             '{{"v":' || v || ',"ts":"' || strftime(t, {ISO}) || '","id":"' || text || '"}}'
           )), '+/', '-_'), '=') AS token FROM raw)
SELECT id, CASE id % 6 WHEN 1 THEN '!' || token WHEN 4 THEN '' ELSE token END AS token,
       CASE WHEN id % 6 IN (0, 5) THEN strftime(t, {ISO}) END AS "timestamp",
       CASE WHEN id % 6 IN (0, 5) THEN id END AS position_id
FROM tokens
""")
def cursor_tokens(spark, sf_dir):
    """Tokens of all rows, some of them spoiled, read back."""
    logs = views.event_logs(spark, sf_dir)
    token = encode_cursor(F.col("timestamp"), F.col("id"))
    plain = F.unbase64(F.translate(token, "-_", "+/")).cast("string")
    versioned = F.replace(plain, F.lit('"v":1'), F.lit('"v":2'))
    lettered = F.replace(plain, F.lit('"id":"'), F.lit('"id":"x'))

    def again(text):
        return F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_")

    case = F.col("id") % 6
    spoiled = (
        F.when(case == 1, F.concat(F.lit("!"), token))
        .when(case == 2, again(versioned))
        .when(case == 3, again(lettered))
        .when(case == 4, "")
        .otherwise(token)
    )
    read = logs.select("id", spoiled.alias("token"))
    read = read.select("id", "token", decode_cursor(F.col("token")).alias("position"))
    return read.select(
        "id", "token",
        iso_text(F.col("position.timestamp")).alias("timestamp"),
        F.col("position.id").alias("position_id"),
    )


# ---------------------------------------------------------- texts and discovery

LONG_WORD = (
    r"[^\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]{4,}"
)


@query(f"""
WITH w AS (SELECT doc_id, regexp_replace(regexp_extract(text, '{LONG_WORD}'),
                                         '[^A-Za-z0-9]', '', 'g') AS word FROM documents)
SELECT doc_id, CASE WHEN length(word) >= 4 THEN word END AS word FROM w
""")
def first_words(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents")
    return documents.select("doc_id", first_long_word(F.col("text")).alias("word"))


@query(f"""
WITH {EVENT_LOGS}
SELECT id, strftime(t, {ISO}) AS "end", service, 'k' AS attr_key, k AS attr_value,
       CASE WHEN length(service) >= 4 THEN service ELSE 'user' END AS word
FROM logs
""")
def described_rows(spark, sf_dir):
    return describe_rows(views.event_logs(spark, sf_dir))


@query(f"""
WITH {EVENT_LOGS},
newest AS (SELECT * FROM logs ORDER BY t DESC, id DESC LIMIT 1),
busy AS (SELECT logs.service, count(*) AS rows FROM logs, newest
         WHERE logs.t >= newest.t - INTERVAL 24 HOURS AND logs.t < newest.t + INTERVAL 1 SECOND
         GROUP BY 1
         ORDER BY 2 DESC,
                  min(time_bucket(INTERVAL '24 hours', logs.t, newest.t - INTERVAL 24 HOURS)), 1
         LIMIT 1)
SELECT strftime(t, {ISO}) AS "end", (SELECT service FROM busy) AS service,
       'k' AS attr_key, k AS attr_value,
       CASE WHEN length(service) >= 4 THEN service ELSE 'user' END AS word
FROM newest
""")
def discovered(spark, sf_dir):
    return discover(views.event_logs(spark, sf_dir))


@query("""
WITH p AS (SELECT event_id, ts, event_id % 4 AS form, 26 + user_id % 6 AS day,
                  (user_id % 24) AS zh, (event_id % 60) AS zm FROM events)
SELECT event_id,
  CASE form
    WHEN 0 THEN epoch_us(ts) // 1000
    WHEN 1 THEN epoch_us(ts) // 1000000 * 1000 - (zh * 60 + zm) * 60000
    WHEN 2 THEN epoch_ms(TIMESTAMP '2023-02-01') + (day - 1) * 86400000 + (zh * 60 + zm) * 60000
    ELSE CASE WHEN day <= 30 THEN
      epoch_ms(TIMESTAMP '2023-11-01') + day * 86400000 END
  END AS millis
FROM p
""")
def parsed_times(spark, sf_dir):
    """Times written in four forms and read back: microseconds, offsets of up to
    23:59, days past the end of February, and 24:00 with an impossible day 32."""
    events = views.table(spark, sf_dir, "events")
    form, day = F.col("event_id") % 4, F.lit(26) + F.col("user_id") % 6
    zone = F.format_string("%02d:%02d", F.col("user_id") % 24, F.col("event_id") % 60)
    wide_day = F.when(day <= 30, day).otherwise(32)
    text = (
        F.when(form == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(form == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+"), zone))
        .when(form == 2, F.concat(F.format_string("2023-02-%02dT00:00:00.0009-", day),
                                  F.replace(zone, F.lit(":"), F.lit(""))))
        .otherwise(F.format_string("2023-11-%02dT24:00:00.000Z", wide_day))
    )
    written = events.select("event_id", text.alias("text"))
    return written.select("event_id", iso_millis(F.col("text")).alias("millis"))


@query(f"""
WITH {EVENT_LOGS}
SELECT {LEVEL} AS name, lv AS code, count(*) AS rows,
       count(*) FILTER (service IN ('error')) AS named_error
FROM logs GROUP BY 1, 2
""")
def level_codes(spark, sf_dir):
    """Codes to names and back; a name outside the four has no code."""
    logs = views.event_logs(spark, sf_dir)
    named = logs.select(
        decode_level(F.col("level")).alias("name"), encode_level(F.col("service")).alias("other")
    )
    return named.groupBy("name", encode_level(F.col("name")).cast("bigint").alias("code")).agg(
        F.count("*").alias("rows"), F.count("other").alias("named_error")
    )


# ----------------------------------------------------------------------- ingest

ENTRIES = """
e AS (
  SELECT event_id AS n, event_id // 100 AS b, event_id % 47 AS c, user_id AS u,
         event_type AS service, json_extract_string(props, '$.k') AS k,
         date_trunc('milliseconds', ts) AS t, user_id % 4 AS lv,
         CAST(row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS INTEGER)
           AS idx
  FROM events),
env AS (
  SELECT b, format('batch-{:012d}', b) AS batch_id, row_number() OVER (ORDER BY b) - 1 AS place,
    CASE WHEN b % 290 = 19 THEN 'request body is too large'
         WHEN b % 29 IN (3, 15, 17) THEN 'request body is not valid JSON'
         WHEN b % 29 = 5 THEN 'request body must be a JSON object'
         WHEN b % 29 IN (7, 9) THEN '''logs'' must be an array'
         WHEN b % 29 = 11 THEN '''logs'' must contain at least one entry'
         WHEN b % 29 = 13 THEN 'batch too large: 5001 entries (max 5000)' END AS error
  FROM (SELECT DISTINCT b FROM e)),
judged AS (
  SELECT e.*, batch_id, place,
    CASE WHEN n % 470 = 15 THEN 'message too long: 65537 > 65536 chars' ELSE CASE c
      WHEN 0 THEN 'entry must be an object'
      WHEN 1 THEN 'entry must be an object'
      WHEN 2 THEN '''timestamp'' must be an ISO 8601 string'
      WHEN 3 THEN '''timestamp'' must be an ISO 8601 string'
      WHEN 4 THEN 'invalid timestamp: ''yesterday'''
      WHEN 5 THEN 'invalid timestamp: ''2024-13-01T00:00:00Z'''
      WHEN 6 THEN 'timestamp is more than 5 minutes in the future'
      WHEN 7 THEN 'timestamp predates the retention window '
                  || '(earliest retained: 2024-01-01T00:00:00.000Z)'
      WHEN 8 THEN 'invalid level: ''critical'''
      WHEN 9 THEN 'invalid level: ''undefined'''
      WHEN 10 THEN 'invalid level: ''[object Object]'''
      WHEN 11 THEN 'invalid level: ''2'''
      WHEN 12 THEN '''service'' must be a non-empty string'
      WHEN 13 THEN '''service'' must be a non-empty string'
      WHEN 14 THEN '''message'' must be a non-empty string'
      WHEN 15 THEN '''message'' must be a non-empty string'
      WHEN 16 THEN 'attributes must be a flat object'
      WHEN 17 THEN 'attributes must be a flat object'
      WHEN 18 THEN 'too many attributes: 65 > 64'
      WHEN 19 THEN 'attribute key must be non-empty'
      WHEN 20 THEN 'attribute key too long (>128 chars)'
      WHEN 21 THEN 'attribute ''a'' must be string, number, or boolean'
      WHEN 22 THEN 'attribute ''a'' must be string, number, or boolean'
      WHEN 23 THEN 'attribute ''a'' must be a finite number'
      WHEN 24 THEN 'attribute ''a'' value too long (>1024 chars)' END END AS reason,
    CASE c WHEN 27 THEN TIMESTAMP '2024-01-15 10:00:00.500'
           WHEN 28 THEN TIMESTAMP '2024-01-06'
           WHEN 30 THEN TIMESTAMP '2024-01-30 18:29:59.123' ELSE t END AS moment,
    CASE c WHEN 25 THEN '' WHEN 26 THEN 'm=100000,n=1.5,s=1e+21,t=1e-7' WHEN 29 THEN 'a=y'
           ELSE 'k=' || k || ',ok=true,user_id=' || u END AS attrs
  FROM e JOIN env USING (b) WHERE error IS NULL)
"""


@query(f"""
WITH {ENTRIES}
SELECT batch_id, CAST(NULL AS VARCHAR) AS error, idx AS index, reason,
       CASE WHEN reason IS NULL THEN strftime(moment, {ISO}) END AS "timestamp",
       CASE WHEN reason IS NULL THEN {LEVEL} END AS level,
       CASE WHEN reason IS NULL THEN service END AS service,
       CASE WHEN reason IS NULL THEN service || ' by user ' || u END AS message,
       CASE WHEN reason IS NULL THEN attrs END AS attributes
FROM judged
UNION ALL
SELECT batch_id, error, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM env WHERE error IS NOT NULL
""")
def ingest_verdicts(spark, sf_dir):
    verdicts = judge_batches(views.event_batches(spark, sf_dir))
    return verdicts.select(
        "batch_id", F.col("envelope_error").alias("error"), "index", "reason",
        iso_text(F.col("timestamp")).alias("timestamp"),
        decode_level(F.col("level")).alias("level"), "service", "message",
        attribute_text().alias("attributes"),
    )


ACKNOWLEDGED = f"""
WITH {ENTRIES},
answers AS (
  SELECT batch_id, count(*) FILTER (reason IS NULL) AS accepted,
         coalesce(CAST(to_json(list({{'index': idx, 'reason': reason}} ORDER BY idx)
                  FILTER (reason IS NOT NULL)) AS VARCHAR), '[]') AS rejected
  FROM judged GROUP BY 1)
SELECT env.batch_id,
       CASE WHEN error = 'request body is too large' THEN 413
            WHEN error IS NOT NULL OR accepted = 0 THEN 400 ELSE 200 END AS status,
       CASE WHEN error IS NULL AND accepted = 0 THEN 'all entries rejected' ELSE error END AS error,
       coalesce(accepted, 0) AS accepted, coalesce(rejected, '[]') AS rejected
FROM env LEFT JOIN answers USING (batch_id)
"""


def answer_rows(answers: DataFrame) -> DataFrame:
    return answers.select(
        "batch_id", "status", "error", "accepted", F.to_json("rejected").alias("rejected")
    )


@query(ACKNOWLEDGED)
def ingest_answers(spark, sf_dir):
    return answer_rows(acknowledge(judge_batches(views.event_batches(spark, sf_dir))))


@query(f"WITH {ENTRIES} SELECT batch_id, idx AS index, reason FROM judged WHERE reason IS NOT NULL")
def ingest_rejects(spark, sf_dir):
    verdicts = judge_batches(views.event_batches(spark, sf_dir))
    return rejected_entries(verdicts).select("batch_id", "index", "reason")


@query(f"""
WITH {ENTRIES}
SELECT CAST(1 + place * 5000 + idx AS VARCHAR) AS id, strftime(moment, {ISO}) AS "timestamp",
       {LEVEL} AS level, service, service || ' by user ' || u AS message, attrs AS attributes,
       strftime(moment, '%Y-%m-%d') AS event_date
FROM judged WHERE reason IS NULL
""")
def stored_rows(spark, sf_dir):
    """The table after a batch ingest, read back: ids, days and all columns."""
    configure(spark)
    target = LogTable(scratch_dir(spark, "stored"))
    ingest(views.event_batches(spark, sf_dir), target, "load-000000000000")
    rows = read_logs(spark, target)
    return shown(rows.select(*output_columns(), F.col("event_date").cast("string")))


# The stored table of a data folder is ingested once per session and then shared.
_ingested: dict[tuple[str, str], LogTable] = {}


def ingested(spark: SparkSession, sf_dir: str) -> LogTable:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ingested:
        configure(spark)
        target = LogTable(scratch_dir(spark, "ingested"))
        ingest(views.event_batches(spark, sf_dir), target, "load-0")
        _ingested[key] = target
    return _ingested[key]


STORED = f"""{ENTRIES},
stored AS (SELECT 1 + place * 5000 + idx AS id, moment AS t, lv, service,
                  service || ' by user ' || u AS message, attrs
           FROM judged WHERE reason IS NULL)"""


@query(f"""
WITH {STORED}
SELECT strftime(time_bucket(INTERVAL '1 hour', t, TIMESTAMP '2024-01-10'), {ISO}) AS start,
       {LEVEL} AS "group", count(*) AS count
FROM stored WHERE t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-20' GROUP BY 1, 2
""")
def stored_bucket_by_level(spark, sf_dir):
    arguments = {"since": "2024-01-10T00:00:00Z", "until": "2024-01-20T00:00:00Z",
                 "bucket": "1h", "group_by": "level"}
    return bucket_rows(count_by_bucket(read_logs(spark, ingested(spark, sf_dir)), arguments))


@query(f"""
WITH {STORED}
SELECT strftime(time_bucket(INTERVAL '5 minutes', t, TIMESTAMP '2024-01-03 00:01:00'), {ISO}) AS start,
       {LEVEL} AS "group", count(*) AS count
FROM stored WHERE t >= TIMESTAMP '2024-01-03 00:01:00' AND t < TIMESTAMP '2024-01-28 12:00:00' GROUP BY 1, 2
""")
def rollup_bucket_by_level(spark, sf_dir):
    """From the counts per minute alone: buckets that begin on whole minutes."""
    arguments = {"since": "2024-01-03T00:01:00Z", "until": "2024-01-28T12:00:00Z",
                 "bucket": "5m", "group_by": "level"}
    return bucket_rows(count_table(spark, ingested(spark, sf_dir), arguments))


@query(f"""
WITH {STORED}
SELECT strftime(time_bucket(INTERVAL '1 hour', t, TIMESTAMP '2024-01-04 00:30:00'), {ISO}) AS start,
       service AS "group", count(*) AS count
FROM stored WHERE t >= TIMESTAMP '2024-01-04 00:30:00' AND t < TIMESTAMP '2024-01-29 10:59:31.25'
  AND lv = 2 GROUP BY 1, 2
""")
def rollup_bucket_ragged_ends(spark, sf_dir):
    """The last bucket ends inside a minute, whose rows are counted themselves."""
    arguments = {"since": "2024-01-04T00:30:00Z", "until": "2024-01-29T10:59:31.250Z",
                 "bucket": "1h", "group_by": "service", "level": "warn"}
    return bucket_rows(count_table(spark, ingested(spark, sf_dir), arguments))


def placed(page) -> list[tuple]:
    """Rows of a fetched page with their place, so that their order is compared."""
    return [
        (place, r["id"], r["timestamp"], r["level"], r["service"], r["message"])
        for place, r in enumerate(page.logs)
    ]


PLACED = "place long, id string, timestamp string, level string, service string, message string"


def stored_page_sql(where: str, limit: int) -> str:
    return f"""
WITH {STORED}
SELECT row_number() OVER (ORDER BY t DESC, id DESC) - 1 AS place, CAST(id AS VARCHAR) AS id,
       strftime(t, {ISO}) AS "timestamp", {LEVEL} AS level, service, message
FROM stored WHERE {where} ORDER BY t DESC, stored.id DESC LIMIT {limit}
"""


@query(stored_page_sql(
    "t >= TIMESTAMP '2024-01-05' AND (t, id) < (TIMESTAMP '2024-01-18 06:00:00', 700)", 200
))
def stored_page(spark, sf_dir):
    cursor = token_of(text_millis("2024-01-18T06:00:00Z"), 700)
    arguments = {"since": "2024-01-05T00:00:00Z", "cursor": cursor, "limit": "200"}
    page = fetch_page(read_logs(spark, ingested(spark, sf_dir)), arguments)
    return spark.createDataFrame(placed(page), PLACED)


@query(stored_page_sql("service = 'click'", 50))
def stored_page_newest_days(spark, sf_dir):
    """Stops at the newest days that fill the page."""
    table = ingested(spark, sf_dir)
    page = fetch_page(
        read_logs(spark, table), {"service": "click", "limit": "50"}, log_days(spark, table)
    )
    return spark.createDataFrame(placed(page), PLACED)


@query(f"""
WITH {STORED}
SELECT strftime(t, '%Y-%m-%d') AS event_date, CAST(1 AS BIGINT) AS batches, count(*) AS rows, min(id) AS first_id,
       max(id) AS last_id, CAST(min(lv) AS SMALLINT) AS lowest, CAST(max(lv) AS SMALLINT) AS highest
FROM stored GROUP BY 1
""")
def stored_totals(spark, sf_dir):
    """From the footers of the table's files alone."""
    totals = day_totals(spark, ingested(spark, sf_dir))
    return totals.withColumn("event_date", F.col("event_date").cast("string"))


def day_counts(spark: SparkSession, table: LogTable) -> DataFrame:
    rows = read_logs(spark, table)
    return rows.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


DAY_COUNTS = (
    "SELECT strftime(t, '%Y-%m-%d') AS event_date, count(*) AS rows, min(id) AS first_id, "
    "max(id) AS last_id FROM stored"
)


@query(f"WITH {STORED} {DAY_COUNTS} WHERE t >= TIMESTAMP '2024-01-11' GROUP BY 1")
def kept_after_retention(spark, sf_dir):
    """Ten days after the requests: day 30 stays, day 31 is dropped whole."""
    configure(spark)
    table = LogTable(scratch_dir(spark, "kept"))
    ingest(views.event_batches(spark, sf_dir), table, "load-0")
    run_maintenance(spark, table, date(2024, 2, 10))
    return day_counts(spark, table)


@query(f"WITH {STORED} {DAY_COUNTS} GROUP BY 1")
def compacted_rows(spark, sf_dir):
    """Four ingest batches of requests that came one after the other; then all days
    are rewritten as one folder each, and the old folders removed."""
    configure(spark)
    table = LogTable(scratch_dir(spark, "compacted"))
    raw = views.event_batches(spark, sf_dir)
    bounds = raw.select("batch_id").agg(F.min("batch_id"), F.max("batch_id")).first()
    first, last = (int(b.removeprefix("batch-")) for b in bounds)
    cuts = [f"batch-{first + (last + 1 - first) * i // 4:012d}" for i in range(5)]
    for number, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        ingest(raw.where((F.col("batch_id") >= low) & (F.col("batch_id") < high)), table, f"load-{number}")
    for day in log_days(spark, table):
        compact_day(spark, table, day)
    purge_replaced(spark, table)
    return day_counts(spark, table)


@query(f"WITH {ENTRIES} SELECT strftime(moment, '%Y-%m-%d') AS event_date, count(*) AS rows, "
       "count(*) AS ids FROM judged WHERE reason IS NULL GROUP BY 1")
def restarted_rows(spark, sf_dir):
    """Half of the requests from one stream, the rest from one that starts anew."""
    configure(spark)
    root = scratch_dir(spark, "restarted")
    raw, table = views.event_batches(spark, sf_dir), LogTable(f"{root}/table")
    for half in (0, 1):
        mine = raw.filter(F.pmod(F.crc32(F.col("batch_id").cast("binary")), F.lit(2)) == half)
        mine.write.parquet(f"{root}/raw{half}")
        source = read_batch_table(spark, f"{root}/raw{half}", stream=True)
        start_ingest(source, table, f"{root}/progress{half}", drain=True).awaitTermination()
    rows = read_logs(spark, table)
    return rows.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("ids")
    )


@query(f"""
WITH {ENTRIES},
probes AS (SELECT place, count(*) FILTER (WHERE reason IS NULL) AS accepted FROM judged GROUP BY 1)
SELECT count(*) AS probes, true AS measured FROM probes WHERE accepted > 0
""")
def answered_freshness(spark, sf_dir):
    """Requests with accepted entries, and that each was answered after it came."""
    answers = read_acknowledgements(spark, ingested(spark, sf_dir)).filter("accepted > 0")
    return answers.agg(
        F.count("*").alias("probes"),
        F.coalesce(F.bool_and(F.col("committed_at") > F.col("received_at")), F.lit(True)).alias("measured"),
    )


@query("SELECT count(*) AS requests, 0 AS rows, 0 AS days, count(*) AS refused FROM "
       "(SELECT DISTINCT event_id // 100 FROM events)")
def nothing_accepted(spark, sf_dir):
    """Requests that are all too old: answers, but no row and no day folder."""
    configure(spark)
    table = LogTable(scratch_dir(spark, "refused"))
    late = views.event_batches(spark, sf_dir).withColumn(
        "received_at", F.col("received_at") + F.expr("INTERVAL 1000 DAYS")
    )
    requests = ingest(late, table, "load-0")
    answers = read_acknowledgements(spark, table).agg(F.count_if(F.col("accepted") == 0).alias("refused"))
    return answers.select(
        F.lit(requests).cast("bigint").alias("requests"),
        F.lit(read_logs(spark, table).count()).cast("bigint").alias("rows"),
        F.lit(len(log_days(spark, table))).cast("bigint").alias("days"),
        "refused",
    )


def streamed(spark: SparkSession, sf_dir: str) -> LogTable:
    """The table after a streaming ingest in several micro-batches, drained."""
    configure(spark)
    root = scratch_dir(spark, "streamed")
    views.event_batches(spark, sf_dir).write.parquet(f"{root}/raw")
    source = read_batch_table(spark, f"{root}/raw", stream=True, maxFilesPerTrigger=4)
    target = LogTable(f"{root}/table")
    start_ingest(source, target, f"{root}/progress", drain=True).awaitTermination()
    return target


@query(f"""
WITH {ENTRIES}
SELECT strftime(moment, '%Y-%m-%d') AS event_date, {LEVEL} AS level, count(*) AS rows,
       count(*) AS ids
FROM judged WHERE reason IS NULL GROUP BY 1, 2
""")
def streamed_rows(spark, sf_dir):
    rows = read_logs(spark, streamed(spark, sf_dir))
    return rows.groupBy(
        F.col("event_date").cast("string").alias("event_date"),
        decode_level(F.col("level")).alias("level"),
    ).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query(ACKNOWLEDGED)
def streamed_answers(spark, sf_dir):
    return answer_rows(read_acknowledgements(spark, streamed(spark, sf_dir)))


@query(f"WITH {ENTRIES} SELECT reason, count(*) AS rows FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def streamed_rejects(spark, sf_dir):
    rejected = read_rejected(spark, streamed(spark, sf_dir))
    return rejected.groupBy("reason").agg(F.count("*").alias("rows"))


@query(f"WITH {ENTRIES} SELECT strftime(moment, '%Y-%m-%d') AS event_date, service, count(*) AS rows, "
       "count(*) AS ids FROM judged WHERE reason IS NULL GROUP BY 1, 2")
def timed_stream_rows(spark, sf_dir):
    """A stream that flushes by the clock; what waits is finished before it stops."""
    configure(spark)
    root = scratch_dir(spark, "timed")
    views.event_batches(spark, sf_dir).write.parquet(f"{root}/raw")
    source = read_batch_table(spark, f"{root}/raw", stream=True, maxFilesPerTrigger=4)
    table = LogTable(f"{root}/table")
    stop_when_drained(start_ingest(source, table, f"{root}/progress"))
    return read_logs(spark, table).groupBy(
        F.col("event_date").cast("string").alias("event_date"), "service"
    ).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


# Waves in which requests are sent to a running stream, and the longest wait for one.
WAVES, PROBE_SECONDS = 3, 120


@query(f"""
WITH {ENTRIES},
probes AS (SELECT place FROM judged GROUP BY 1 HAVING count(*) FILTER (WHERE reason IS NULL) > 0)
SELECT count(*) AS probes, count(*) AS visible, CAST(0 AS BIGINT) AS timeouts, count(*) > 0 AS passed FROM probes
""")
def probe_freshness(spark, sf_dir):
    """Requests sent to a running stream in waves, and how many became readable in time."""
    configure(spark)
    root = scratch_dir(spark, "probed")
    raw = views.event_batches(spark, sf_dir)
    spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(f"{root}/raw")
    )
    table = LogTable(f"{root}/table")
    running = start_ingest(read_batch_table(spark, f"{root}/raw", stream=True), table, f"{root}/progress")

    def send(wave: int) -> DataFrame:
        mine = raw.where(F.pmod(F.crc32(F.col("batch_id").cast("binary")), F.lit(WAVES)) == wave)
        mine.write.mode("append").parquet(f"{root}/raw")
        return mine

    try:
        sends = [lambda wave=wave: send(wave) for wave in range(WAVES)]
        probes = probe_stream(spark, table, running, sends, PROBE_SECONDS)
        return measures.freshness(probes, PROBE_SECONDS * 1000).select("probes", "visible", "timeouts", "passed")
    finally:
        running.stop()


# ------------------------------------------------------------------ maintenance


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    return events.select(F.to_date("ts").alias("event_date"))


def partition_rows(partitions: DataFrame) -> DataFrame:
    return partitions.select(
        "partition_name",
        iso_text(F.col("lower_bound")).alias("lower_bound"),
        iso_text(F.col("upper_bound")).alias("upper_bound"),
    )


PARTITION = f"""strftime(d, 'logs_%Y_%m_%d') AS partition_name, strftime(d, {ISO}) AS lower_bound,
strftime(d + INTERVAL '1 day', {ISO}) AS upper_bound"""
EVENT_DAYS = "days AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events)"


@query(f"WITH {EVENT_DAYS} SELECT {PARTITION} FROM days")
def partitions(spark, sf_dir):
    return partition_rows(maintenance.day_partitions(event_days(spark, sf_dir)))


@query(f"""
WITH {EVENT_DAYS},
required AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-02',
                                           INTERVAL '1 day')) AS d)
SELECT {PARTITION} FROM required WHERE d NOT IN (SELECT d FROM days)
""")
def missing_days(spark, sf_dir):
    required = maintenance.required_days(spark, date(2024, 1, 19))
    return partition_rows(maintenance.missing_partitions(event_days(spark, sf_dir), required))


@query(f"""
WITH {EVENT_DAYS}
SELECT {PARTITION} FROM days WHERE d + INTERVAL '1 day' <= TIMESTAMP '2024-01-16'
""")
def expired_days(spark, sf_dir):
    return partition_rows(
        maintenance.expired_partitions(event_days(spark, sf_dir), date(2024, 2, 15))
    )


# ----------------------------------------------------------------- measurements

REQUESTS = """
r AS (
  SELECT event_id AS seq, event_type AS shape, ts, value AS ms, event_id % 53 <> 0 AS net,
         CASE user_id % 5 WHEN 2 THEN 400 WHEN 3 THEN 429 WHEN 4 THEN 500 ELSE 200 END AS status,
         CASE WHEN user_id % 5 < 2 THEN user_id % 101 ELSE 0 END AS rows,
         CASE WHEN user_id % 5 < 2 THEN 500 - event_id % 7 ELSE 0 END AS accepted,
         user_id + 1000 AS bytes
  FROM events)
"""


def ranked_sql(percent: float) -> str:
    return f"max(ms) FILTER (p = greatest(ceil({percent / 100}::DOUBLE * n), 1)) AS p{percent}"


SUMMARIES = f"""
summaries AS (
  SELECT pooled, CASE WHEN NOT pooled THEN shape END AS shape, max(requests) AS requests,
         count(ms) AS count, min(ms) AS min, round(avg(ms), 6) AS mean,
         {", ".join(ranked_sql(p) for p in (50, 90, 95, 99))}, max(ms) AS max, max(errors) AS errors
  FROM (
    SELECT pooled, shape, ms, net,
           row_number() OVER (PARTITION BY pooled, shape, net ORDER BY ms) AS p,
           count(*) OVER (PARTITION BY pooled, shape, net) AS n,
           count(*) OVER (PARTITION BY pooled, shape) AS requests,
           count(*) FILTER (NOT net OR status <> 200) OVER (PARTITION BY pooled, shape) AS errors
    FROM (SELECT false AS pooled, shape, ms, net, status FROM r
          UNION ALL SELECT true, '', ms, net, status FROM r)) WHERE net GROUP BY 1, 2)
"""


@query(f"WITH {REQUESTS}, {SUMMARIES} SELECT * FROM summaries")
def latency_summary(spark, sf_dir):
    summary = measures.latency_summary(views.event_requests(spark, sf_dir))
    return summary.withColumn("mean", F.round("mean", 6))


@query(f"""
WITH {REQUESTS}, {SUMMARIES},
worst AS (SELECT shape, p95 FROM summaries WHERE NOT pooled ORDER BY p95 DESC, shape LIMIT 1)
SELECT shape, worst.p95, s.p95 AS overall_p95, requests, errors,
       (SELECT count(*) FROM summaries WHERE NOT pooled AND p95 > 50) AS over_target,
       worst.p95 < 50 AND errors = 0 AS passed
FROM worst, (SELECT p95, requests, errors FROM summaries WHERE pooled) s
""")
def worst_shape(spark, sf_dir):
    summary = measures.latency_summary(views.event_requests(spark, sf_dir))
    return measures.worst_shape(summary, target_ms=50)


@query(f"""
WITH {REQUESTS}
SELECT shape, count(*) AS requests, count(*) FILTER (net AND status = 200) AS ok,
       count(*) FILTER (net AND status = 400) AS rejected,
       count(*) FILTER (net AND status = 429) AS throttled,
       count(*) FILTER (NOT net OR status = 500) AS failed,
       count(*) FILTER (NOT net) AS network_failures, count(*) FILTER (net) AS latency_samples
FROM r GROUP BY 1
""")
def outcomes(spark, sf_dir):
    return measures.outcomes(views.event_requests(spark, sf_dir), "shape")


@query(f"""
WITH {REQUESTS},
sums AS (SELECT shape, (max(epoch_us(ts) / 1000.0::DOUBLE + ms) - min(epoch_us(ts) / 1000.0::DOUBLE))
                  / 1000 AS seconds, count(*) AS requests, CAST(500 * count(*) AS BIGINT) AS sent,
                CAST(sum(CASE WHEN net THEN accepted ELSE 0 END) AS BIGINT) AS accepted,
                CAST(sum(bytes) AS BIGINT) AS bytes,
                count(*) FILTER (NOT net OR status IN (429, 500)) AS dropped
         FROM r GROUP BY 1)
SELECT shape, round(seconds, 6) AS seconds, requests, sent, accepted, bytes, dropped,
       round(sent / seconds, 6) AS sent_per_sec, round(accepted / seconds, 6) AS accepted_per_sec,
       round(requests / seconds, 6) AS requests_per_sec
FROM sums
""")
def throughput(spark, sf_dir):
    rates = measures.throughput(views.event_requests(spark, sf_dir), "shape")
    for name in ("seconds", "sent_per_sec", "accepted_per_sec", "requests_per_sec"):
        rates = rates.withColumn(name, F.round(name, 6))
    return rates


@query(f"""
WITH {REQUESTS},
i AS (SELECT date_trunc('minute', ts) AS m,
             CAST(sum(CASE WHEN net THEN accepted ELSE 0 END) AS BIGINT) AS accepted,
             count(*) AS requests, count(*) FILTER (net AND status = 429) AS throttled,
             count(*) FILTER (NOT net OR status = 500) AS failed
      FROM r GROUP BY 1)
SELECT strftime(m, {ISO}) AS interval_start, accepted, round(accepted / 60.0::DOUBLE, 6) AS rate,
       CAST(sum(accepted) OVER w AS BIGINT) AS total_accepted,
       CAST(sum(requests) OVER w AS BIGINT) AS total_requests,
       CAST(sum(throttled) OVER w AS BIGINT) AS total_throttled,
       CAST(sum(failed) OVER w AS BIGINT) AS total_failed
FROM i WINDOW w AS (ORDER BY m)
""")
def interval_rate(spark, sf_dir):
    return rate_rows(measures.interval_rate(views.event_requests(spark, sf_dir), seconds=60))


def rate_rows(rates: DataFrame) -> DataFrame:
    return rates.withColumn("interval_start", iso_text(F.col("interval_start"))).withColumn(
        "rate", F.round("rate", 6)
    )


@query(f"""
WITH {REQUESTS},
busy AS (SELECT time_bucket(INTERVAL '90 seconds', ts, TIMESTAMP '1970-01-01') AS m,
                CAST(sum(CASE WHEN net THEN accepted ELSE 0 END) AS BIGINT) AS accepted,
                count(*) AS requests, count(*) FILTER (net AND status = 429) AS throttled,
                count(*) FILTER (NOT net OR status = 500) AS failed
         FROM r GROUP BY 1),
i AS (SELECT m, coalesce(accepted, 0) AS accepted, coalesce(requests, 0) AS requests,
             coalesce(throttled, 0) AS throttled, coalesce(failed, 0) AS failed
      FROM (SELECT unnest(generate_series((SELECT min(m) FROM busy), (SELECT max(m) FROM busy),
                                          INTERVAL '90 seconds')) AS m) LEFT JOIN busy USING (m))
SELECT strftime(m, {ISO}) AS interval_start, accepted, round(accepted / 90.0::DOUBLE, 6) AS rate,
       CAST(sum(accepted) OVER w AS BIGINT) AS total_accepted,
       CAST(sum(requests) OVER w AS BIGINT) AS total_requests,
       CAST(sum(throttled) OVER w AS BIGINT) AS total_throttled,
       CAST(sum(failed) OVER w AS BIGINT) AS total_failed
FROM i WINDOW w AS (ORDER BY m)
""")
def interval_rate_every(spark, sf_dir):
    """Also the intervals without any request."""
    return rate_rows(measures.interval_rate(views.event_requests(spark, sf_dir), seconds=90, every=True))


@query(f"""
WITH {REQUESTS},
g AS (SELECT shape, count(*) AS requests,
             (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE AS seconds
      FROM r GROUP BY 1)
SELECT shape, requests, round(seconds, 6) AS seconds, round(requests / seconds, 6) AS rate,
       requests / seconds >= 0.001::DOUBLE * 0.95::DOUBLE AS passed
FROM g
""")
def achieved_rate(spark, sf_dir):
    rates = measures.achieved_rate(views.event_requests(spark, sf_dir), 0.001, "shape")
    return rates.withColumn("seconds", F.round("seconds", 6)).withColumn(
        "rate", F.round("rate", 6)
    )


@query(f"""
WITH {REQUESTS}
SELECT shape, count(*) FILTER (net AND status = 200) AS ok,
       CAST(sum(CASE WHEN net THEN rows ELSE 0 END) AS BIGINT) AS rows,
       round(coalesce(sum(CASE WHEN net THEN rows ELSE 0 END)
             / nullif(count(*) FILTER (net AND status = 200), 0)::DOUBLE, 0), 6) AS avg_rows
FROM r GROUP BY 1
""")
def average_rows(spark, sf_dir):
    rows = measures.average_rows(views.event_requests(spark, sf_dir), "shape")
    return rows.withColumn("avg_rows", F.round("avg_rows", 6))


@query(f"""
WITH {REQUESTS},
pages AS (SELECT seq + 1 AS page, ms, rows, count(*) OVER () AS depth FROM r),
segments AS (
  SELECT 'first' AS segment, ms, rows FROM pages
  WHERE page <= least(10, greatest(1, depth // 10))
  UNION ALL SELECT 'last', ms, rows FROM pages
  WHERE page > depth - least(10, greatest(1, depth // 10))
  UNION ALL SELECT 'all', ms, rows FROM pages),
placed AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY ms) AS p,
                  count(*) OVER (PARTITION BY segment) AS n FROM segments),
s AS (SELECT segment, count(*) AS pages, CAST(sum(rows) AS BIGINT) AS rows, {ranked_sql(50)},
             {ranked_sql(95)}, max(ms) AS max FROM placed GROUP BY 1),
q AS (SELECT max(p50) FILTER (segment = 'last') / max(p50) FILTER (segment = 'first') AS ratio
      FROM s)
SELECT s.*, round(ratio, 6) AS ratio, ratio < 2 AS flat FROM s, q
""")
def depth_ratio(spark, sf_dir):
    requests = views.event_requests(spark, sf_dir)
    pages = requests.select((F.col("seq") + 1).alias("page"), "elapsed_ms", "rows")
    return measures.depth_ratio(pages).withColumn("ratio", F.round("ratio", 6))


@query(f"""
WITH {REQUESTS},
v AS (SELECT ms, row_number() OVER (ORDER BY ms) AS p, count(*) OVER () AS n
      FROM r WHERE ms < 60)
SELECT (SELECT count(*) FROM r) AS probes, count(*) AS visible,
       (SELECT count(*) FROM r) - count(*) AS timeouts, min(ms) AS min, {ranked_sql(50)},
       {ranked_sql(95)}, max(ms) AS max,
       count(*) > 0 AND (SELECT count(*) FROM r) = count(*) AS passed
FROM v
""")
def freshness(spark, sf_dir):
    probes = views.event_requests(spark, sf_dir).select("elapsed_ms")
    return measures.freshness(probes, target_ms=60)
