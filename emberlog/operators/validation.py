"""Envelope and entry checks: every entry gets a verdict and, if bad, a reason.

The clock is the batch's ``received_at`` column, never the time the job runs, so
reading a batch again gives the same verdicts.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.functions.levels import encode_level
from emberlog.functions.texts import longer_than, utf16_length
from emberlog.functions.times import from_millis, iso_millis, iso_text
from emberlog.functions.variants import (
    array_items,
    display_text,
    is_number,
    is_whole,
    named_fields,
    object_fields,
    scalar_text,
    single_value,
    string_value,
    type_name,
    wrapped_values,
)
from emberlog.schema import (
    DAY_MS,
    MAX_ATTRIBUTE_KEY_LENGTH,
    MAX_ATTRIBUTE_VALUE_LENGTH,
    MAX_ATTRIBUTES,
    MAX_BATCH_ENTRIES,
    MAX_BODY_BYTES,
    MAX_FUTURE_SKEW_MS,
    MAX_MESSAGE_LENGTH,
    RETENTION_DAYS,
)
from emberlog.session import configure

BODY_TOO_LARGE = "request body is too large"
BODY_NOT_JSON = "request body is not valid JSON"
NO_CLOCK = "request has no receipt time"

FIELDS = ("timestamp", "level", "service", "message", "attributes")

# Type of an object whose values all read as text without further rules. Every
# type follows a colon, so no key can make another type pass for these.
PLAIN_ATTRIBUTES = r"^OBJECT<(?:(?:\w+: (?:STRING|BIGINT|BOOLEAN)(?:, )?)*)>\z"


# What is known of the request goes along with every entry of it.
REQUEST = ("batch_id", "received_at", "request", "fingerprint")


def read_envelopes(batches: DataFrame) -> DataFrame:
    """The request columns, ``envelope_error`` and ``logs``, the body dropped."""
    request = [
        F.col(name) if name in batches.columns else F.lit(None).cast("bigint").alias(name)
        for name in REQUEST
    ]
    in_size = F.octet_length("body") <= MAX_BODY_BYTES
    parsed = batches.select(
        *request,
        in_size.alias("in_size"),
        F.when(in_size, wrapped_values(F.col("body"))).alias("wrapped"),
        F.when(in_size, is_whole(F.col("body"))).alias("whole"),
    )
    opened = parsed.select(
        *REQUEST,
        "in_size",
        single_value(F.col("wrapped"), F.col("whole")).alias("document"),
    )
    named = opened.select(
        *REQUEST,
        "in_size",
        F.col("document").isNotNull().alias("readable"),
        named_fields(F.col("document"), "logs").alias("fields"),
    )
    listed = named.select(
        *REQUEST,
        "in_size",
        "readable",
        F.col("fields").isNotNull().alias("is_object"),
        array_items(F.col("fields.logs")).alias("logs"),
    )
    entries = F.size("logs")
    error = (
        F.when(~F.col("in_size"), BODY_TOO_LARGE)
        # Without the clock neither the future nor the retention rule can be held.
        .when(F.col("received_at").isNull(), NO_CLOCK)
        .when(~F.col("readable"), BODY_NOT_JSON)
        .when(~F.col("is_object"), "request body must be a JSON object")
        .when(F.col("logs").isNull(), "'logs' must be an array")
        .when(entries == 0, "'logs' must contain at least one entry")
        .when(
            entries > MAX_BATCH_ENTRIES,
            F.format_string(f"batch too large: %d entries (max {MAX_BATCH_ENTRIES})", entries),
        )
    )
    return listed.select(*REQUEST, error.alias("envelope_error"), "logs")


def explode_entries(envelopes: DataFrame) -> DataFrame:
    """One row per entry with its zero-based index; a refused batch keeps one
    row, without an index, so it is not lost on the way."""
    entries = F.when(F.col("envelope_error").isNull(), F.col("logs"))
    return envelopes.select(
        *REQUEST, "envelope_error",
        F.posexplode_outer(entries).alias("index", "entry"),
    )


def judge_batches(batches: DataFrame, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Verdicts of all entries of raw batches.

    ``(batch_id, received_at, request, fingerprint, envelope_error, index, reason, timestamp, level,
    service, message, attributes)``; an accepted entry has an index and neither
    error nor reason.
    """
    configure(batches.sparkSession)
    return judge_entries(explode_entries(read_envelopes(batches)), retention_days)


def judge_entries(entries: DataFrame, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Verdicts of exploded entries.

    Texts leave the JSON values early and unusual values are carried on only
    where a rule or a message still needs them: a JSON value drags the key
    dictionary of its whole batch along.
    """
    application = entries.sparkSession.sparkContext.applicationId
    verdicts = entries
    for columns in _verdict_steps(application, retention_days):
        verdicts = verdicts.select(*columns)
    return verdicts


CARRIED = (*REQUEST, "envelope_error", "index")


@lru_cache(maxsize=4)
def _verdict_steps(application: str, retention_days: int) -> list[list[Column]]:
    """The projections from an exploded entry to its verdict, one after another.

    Building these columns takes seconds of calls into the JVM, so one
    application builds them once and not again for every micro-batch.
    """
    carried = [F.col(name) for name in CARRIED]

    def keep(*names: str) -> list[Column]:
        return [*carried, *[F.col(name) for name in names]]

    opened = [*carried, named_fields(F.col("entry"), *FIELDS).alias("entry")]
    parts = [
        *carried,
        F.col("entry").isNotNull().alias("is_object"),
        string_value(F.col("entry.timestamp")).alias("time_text"),
        encode_level(string_value(F.col("entry.level"))).alias("level"),
        F.col("entry.level").alias("level_value"),
        string_value(F.col("entry.service")).alias("service"),
        string_value(F.col("entry.message")).alias("message"),
        F.col("entry.attributes").alias("given"),
        type_name(F.col("entry.attributes")).rlike(PLAIN_ATTRIBUTES).alias("plain"),
    ]
    given, plain = F.col("given"), F.col("plain")
    unusual = [
        *keep("is_object", "time_text", "level", "service", "message"),
        iso_millis(F.col("time_text")).alias("millis"),
        F.when(F.col("level").isNull(), F.col("level_value")).alias("level_value"),
        given.isNotNull().alias("has_attributes"),
        F.when(plain, given.cast("map<string,string>")).alias("plain_texts"),
        F.when(~plain, object_fields(given)).alias("values"),
    ]
    texts = F.coalesce(
        F.col("plain_texts"),
        F.when(
            F.col("values").isNotNull(),
            F.transform_values("values", lambda _, v: scalar_text(v, type_name(v))),
        ),
    )
    typed = [F.col("*"), texts.alias("texts")]
    judged = [F.col("*"), _entry_reason(retention_days).alias("reason")]
    good = F.col("index").isNotNull() & F.col("reason").isNull()
    empty = F.create_map().cast("map<string,string>")
    verdict = F.struct(
        *CARRIED,
        F.when(F.col("index").isNotNull(), F.col("reason")).alias("reason"),
        F.when(good, from_millis(F.col("millis"))).alias("timestamp"),
        F.when(good, F.col("level")).alias("level"),
        F.when(good, F.col("service")).alias("service"),
        F.when(good, F.col("message")).alias("message"),
        F.when(good, F.coalesce(F.col("texts"), empty)).alias("attributes"),
    )
    # Generated columns stop a later filter on the verdict from moving down here,
    # where it would evaluate all of the above a second time.
    return [opened, parts, unusual, typed, judged, [F.inline(F.array(verdict))]]


def _entry_reason(retention_days: int) -> Column:
    """The first failing rule's words; null when the entry is good."""
    time_text, millis = F.col("time_text"), F.col("millis")
    service, message = F.col("service"), F.col("message")
    received = F.unix_millis("received_at")
    earliest = received - F.pmod(received, F.lit(DAY_MS)) - retention_days * DAY_MS
    return (
        F.when(~F.col("is_object"), "entry must be an object")
        .when(time_text.isNull(), "'timestamp' must be an ISO 8601 string")
        .when(millis.isNull(), F.concat(F.lit("invalid timestamp: '"), time_text, F.lit("'")))
        .when(
            millis - received > MAX_FUTURE_SKEW_MS,
            "timestamp is more than 5 minutes in the future",
        )
        .when(
            millis < earliest,
            F.concat(
                F.lit("timestamp predates the retention window (earliest retained: "),
                iso_text(from_millis(earliest)),
                F.lit(")"),
            ),
        )
        .when(
            F.col("level").isNull(),
            F.concat(F.lit("invalid level: '"), display_text(F.col("level_value")), F.lit("'")),
        )
        .when(service.isNull() | (service == ""), "'service' must be a non-empty string")
        .when(message.isNull() | (message == ""), "'message' must be a non-empty string")
        .when(
            longer_than(message, MAX_MESSAGE_LENGTH),
            F.format_string(
                f"message too long: %d > {MAX_MESSAGE_LENGTH} chars", utf16_length(message)
            ),
        )
        .when(F.col("has_attributes"), _attributes_reason())
    )


def _attributes_reason() -> Column:
    plain, values, texts = F.col("plain_texts"), F.col("values"), F.col("texts")
    # When all keys together and all values together stay within the limit of
    # one, no single one can pass it. That settles nearly every entry; the rest
    # is judged key by key.
    keys = F.map_keys(texts)
    in_limits = (
        plain.isNotNull()
        & (F.octet_length(F.array_join(keys, "")) <= MAX_ATTRIBUTE_KEY_LENGTH)
        & ~F.array_contains(keys, "")
        & (F.octet_length(F.array_join(F.map_values(plain), "")) <= MAX_ATTRIBUTE_VALUE_LENGTH)
    )
    reasons = F.transform(keys, lambda key: _attribute_reason(key, values, texts))
    first = F.get(F.filter(reasons, lambda reason: reason.isNotNull()), F.lit(0))
    return (
        F.when(texts.isNull(), "attributes must be a flat object")
        .when(
            F.size(texts) > MAX_ATTRIBUTES,
            F.format_string(f"too many attributes: %d > {MAX_ATTRIBUTES}", F.size(texts)),
        )
        .when(~in_limits, first)
    )


def _attribute_reason(key: Column, values: Column, texts: Column) -> Column:
    """The first rule one attribute breaks. ``values`` is null when every value
    is of a plain type, which settles the two rules about types."""

    def about(words: str) -> Column:
        return F.concat(F.lit("attribute '"), key, F.lit(f"' {words}"))

    value = F.try_element_at(values, key)
    type_ = type_name(value)
    infinite = F.abs(F.try_variant_get(value, "$", "double")) == float("inf")
    return (
        F.when(key == "", "attribute key must be non-empty")
        .when(
            longer_than(key, MAX_ATTRIBUTE_KEY_LENGTH),
            f"attribute key too long (>{MAX_ATTRIBUTE_KEY_LENGTH} chars)",
        )
        .when(
            ~(type_.isin("STRING", "BOOLEAN") | is_number(type_)),
            about("must be string, number, or boolean"),
        )
        .when(is_number(type_) & infinite, about("must be a finite number"))
        .when(
            longer_than(F.try_element_at(texts, key), MAX_ATTRIBUTE_VALUE_LENGTH),
            about(f"value too long (>{MAX_ATTRIBUTE_VALUE_LENGTH} chars)"),
        )
    )


def accepted_entries(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("index").isNotNull() & F.col("reason").isNull())


def rejected_entries(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("reason").isNotNull()).select(
        "batch_id", "received_at", "index", "reason"
    )
