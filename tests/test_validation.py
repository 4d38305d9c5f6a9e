import json

import pytest
from conftest import entry, envelope

from emberlog.operators.acknowledge import acknowledge
from emberlog.operators.validation import judge_batches, rejected_entries

GOOD = None
OLD = "timestamp predates the retention window (earliest retained: 2031-07-12T00:00:00.000Z)"
FUTURE = "timestamp is more than 5 minutes in the future"
NOT_TEXT = "'timestamp' must be an ISO 8601 string"
SERVICE = "'service' must be a non-empty string"
MESSAGE = "'message' must be a non-empty string"
FLAT = "attributes must be a flat object"
TYPE = "attribute 'a' must be string, number, or boolean"
VALUE_LONG = "attribute 'a' value too long (>1024 chars)"
KEY_LONG = "attribute key too long (>128 chars)"


def bad_time(text):
    return f"invalid timestamp: '{text}'"


ENTRIES = [
    (entry(), GOOD),
    ("text", "entry must be an object"),
    (None, "entry must be an object"),
    (7, "entry must be an object"),
    ([entry()], "entry must be an object"),
    ({}, NOT_TEXT),
    (entry(timestamp=...), NOT_TEXT),
    (entry(timestamp=5), NOT_TEXT),
    (entry(timestamp=None), NOT_TEXT),
    (entry(timestamp="yesterday"), bad_time("yesterday")),
    (entry(timestamp="2031-08-11"), bad_time("2031-08-11")),
    (entry(timestamp="2031-08-11T11:59:00"), bad_time("2031-08-11T11:59:00")),
    (entry(timestamp="2031-08-11T11:59:00Z\n"), bad_time("2031-08-11T11:59:00Z\n")),
    (entry(timestamp="2031-08-11 11:59:00Z"), bad_time("2031-08-11 11:59:00Z")),
    (entry(timestamp="2031-13-01T00:00:00Z"), bad_time("2031-13-01T00:00:00Z")),
    (entry(timestamp="2031-08-32T00:00:00Z"), bad_time("2031-08-32T00:00:00Z")),
    (entry(timestamp="2031-08-10T24:00:01Z"), bad_time("2031-08-10T24:00:01Z")),
    (entry(timestamp="2031-08-10T23:59:60Z"), bad_time("2031-08-10T23:59:60Z")),
    (entry(timestamp="2031-08-10T23:59:00+24:00"), bad_time("2031-08-10T23:59:00+24:00")),
    (entry(timestamp="2031-08-11T11:59:00Z"), GOOD),
    (entry(timestamp="2031-08-11T11:59:00.5Z"), GOOD),
    (entry(timestamp="2031-08-11T13:59:00+02:00"), GOOD),
    (entry(timestamp="2031-08-11T06:29:00-0530"), GOOD),
    (entry(timestamp="2031-08-11T12:04:59Z"), GOOD),
    (entry(timestamp="2031-08-11T12:05:00.000Z"), GOOD),
    (entry(timestamp="2031-08-11T12:05:00.001Z"), FUTURE),
    (entry(timestamp="2031-08-11T12:05:01Z"), FUTURE),
    (entry(timestamp="2031-07-12T00:00:00.000Z"), GOOD),
    (entry(timestamp="2031-07-11T23:59:59.999Z"), OLD),
    (entry(timestamp="2031-06-27T00:00:00.000Z"), OLD),
    (entry(timestamp="0000-01-01T00:00:00Z"), OLD),
    (entry(level="critical"), "invalid level: 'critical'"),
    (entry(level="ERROR"), "invalid level: 'ERROR'"),
    (entry(level=...), "invalid level: 'undefined'"),
    (entry(level=None), "invalid level: 'null'"),
    (entry(level=3), "invalid level: '3'"),
    (entry(level=True), "invalid level: 'true'"),
    (entry(level={"a": 1}), "invalid level: '[object Object]'"),
    (entry(level=[1, ["x", None], True]), "invalid level: '1,x,,true'"),
    (entry(service=""), SERVICE),
    (entry(service=...), SERVICE),
    (entry(service=5), SERVICE),
    (entry(message=""), MESSAGE),
    (entry(message=...), MESSAGE),
    (entry(message=["m"]), MESSAGE),
    (entry(message="x" * 65_536), GOOD),
    (entry(message="é" * 65_536), GOOD),
    (entry(message="x" * 65_537), "message too long: 65537 > 65536 chars"),
    (entry(message="😀" * 32_769), "message too long: 65538 > 65536 chars"),
    (entry(attributes={}), GOOD),
    (entry(attributes="s"), FLAT),
    (entry(attributes=[1]), FLAT),
    (entry(attributes=None), FLAT),
    (entry(attributes={f"k{i}": i for i in range(64)}), GOOD),
    (entry(attributes={f"k{i}": i for i in range(65)}), "too many attributes: 65 > 64"),
    (entry(attributes={f"k{i}": None for i in range(65)}), "too many attributes: 65 > 64"),
    (entry(attributes={"": 1}), "attribute key must be non-empty"),
    (entry(attributes={"k" * 128: 1}), GOOD),
    (entry(attributes={"é" * 128: 1}), GOOD),
    (entry(attributes={"k" * 129: 1}), KEY_LONG),
    (entry(attributes={"a": None}), TYPE),
    (entry(attributes={"a": {"b": 1}}), TYPE),
    (entry(attributes={"a": [1]}), TYPE),
    (entry(attributes={"a": "v" * 1024, "b": "é" * 1024}), GOOD),
    (entry(attributes={"a": "v" * 1025}), VALUE_LONG),
    (entry(attributes={"a": "😀" * 513}), VALUE_LONG),
    (entry(attributes={"a: STRING, b": None}),
     "attribute 'a: STRING, b' must be string, number, or boolean"),
    (entry(host="extra fields do not matter", attributes={"x": "y"}), GOOD),
]


def test_entry_rules(batches):
    verdicts = judge_batches(batches(envelope(*[given for given, _ in ENTRIES]))).collect()
    got = {row["index"]: row["reason"] for row in verdicts}
    assert len(verdicts) == len(ENTRIES)
    for index, (given, reason) in enumerate(ENTRIES):
        assert got[index] == reason, str(given)[:200]


def test_first_failing_rule_wins(batches):
    worst = entry(timestamp=1, level="x", service="", message="", attributes=None)
    order = []
    for repaired in ("timestamp", "level", "service", "message", "attributes"):
        order.append(dict(worst))
        worst[repaired] = entry(attributes={})[repaired]
    order.append(dict(worst))
    rows = judge_batches(batches(envelope(*order))).orderBy("index").collect()
    assert [row["reason"] for row in rows] == [
        NOT_TEXT, "invalid level: 'x'", SERVICE, MESSAGE, FLAT, None,
    ]


@pytest.fixture
def accepted(batches):
    def read(*bodies):
        rows = judge_batches(batches(*bodies)).orderBy("batch_id", "index").collect()
        assert [row["reason"] for row in rows] == [None] * len(rows)
        return rows

    return read


def test_accepted_form(accepted):
    (row,) = accepted(envelope(entry(
        timestamp="2031-08-11T13:59:00.1239+02:00",
        attributes={"crate": "17b", "line": "L4", "tries": 6},
    )))
    assert row["timestamp"].isoformat() == "2031-08-11T11:59:00.123000"
    assert (row["level"], row["service"], row["message"]) == (3, "mill", "belt slipped twice")
    assert row["attributes"] == {"crate": "17b", "line": "L4", "tries": "6"}


def test_missing_attributes_become_an_empty_map(accepted):
    (row,) = accepted(envelope(entry()))
    assert row["attributes"] == {}


def test_calendar_rollover_and_midnight(accepted, spark, batches):
    rows = accepted(envelope(
        entry(timestamp="2031-07-31T24:00:00Z"), entry(timestamp="2031-08-11T23:59:00+23:59")
    ))
    assert [row["timestamp"].isoformat() for row in rows] == [
        "2031-08-01T00:00:00", "2031-08-11T00:00:00",
    ]
    from datetime import datetime

    march = batches(
        envelope(entry(timestamp="2031-02-30T00:00:00Z"), entry(timestamp="2031-02-29T01:00:00Z")),
        received_at=datetime(2031, 3, 5),
    )
    got = [row["timestamp"].isoformat() for row in judge_batches(march).orderBy("index").collect()]
    assert got == ["2031-03-02T00:00:00", "2031-03-01T01:00:00"]


NUMBERS = {
    "42": "42", "-1.5": "-1.5", "0.1": "0.1", "1.0": "1", "1.50": "1.5", "1e5": "100000",
    "1E+2": "100", "1e20": "100000000000000000000", "1e21": "1e+21", "1.5e300": "1.5e+300",
    "0.000001": "0.000001", "0.0000001": "1e-7", "-2.5e-9": "-2.5e-9", "-0": "0", "-0.0": "0",
    "123456789.125": "123456789.125", "0.1234567890123456789": "0.12345678901234568",
    "9007199254740993": "9007199254740993", "true": "true", "false": "false", '"x"': "x",
    '"t\\tb"': "t\tb", '"C:\\\\Users\\\\me"': "C:\\Users\\me",
}


def test_values_become_text(accepted):
    fields = ",".join(f'"k{i}":{text}' for i, text in enumerate(NUMBERS))
    body = envelope(entry(attributes={}))[: -len('{}}]}')] + "{" + fields + "}}]}"
    (row,) = accepted(body)
    assert row["attributes"] == {f"k{i}": text for i, text in enumerate(NUMBERS.values())}


def test_infinite_number_is_refused(batches):
    body = envelope(entry(attributes={"a": 0})).replace('{"a": 0}', '{"a":1e400}')
    (row,) = judge_batches(batches(body)).collect()
    assert row["reason"] == "attribute 'a' must be a finite number"


def test_repeated_key_keeps_the_last_value(accepted):
    body = envelope(entry(attributes={"a": 0})).replace('{"a": 0}', '{"a":"x","a":"y"}')
    (row,) = accepted(body)
    assert row["attributes"] == {"a": "y"}


def test_control_characters_and_sql_text_survive(accepted):
    texts = ["line\nbreak\ttab\rreturn\\back", "'; DROP TABLE logs; --"]
    rows = accepted(envelope(*[entry(message=t, attributes={"v": t}) for t in texts]))
    assert [row["message"] for row in rows] == texts
    assert [row["attributes"]["v"] for row in rows] == texts


LOGS = '{"logs":[%s]}'
ONE = json.dumps(entry())
NOT_JSON = "request body is not valid JSON"
NOT_OBJECT = "request body must be a JSON object"
NOT_ARRAY = "'logs' must be an array"

ENVELOPES = [
    (LOGS % ONE, 200, None),
    (f"  {LOGS % ONE}\n", 200, None),
    (None, 400, NOT_JSON),
    ("", 400, NOT_JSON),
    ("{", 400, NOT_JSON),
    ("{'logs':[1]}", 400, NOT_JSON),
    ('{"logs":[NaN]}', 400, NOT_JSON),
    (LOGS % ONE + " x", 400, NOT_JSON),
    (LOGS % ONE + "],[", 400, NOT_JSON),
    (LOGS % ONE + "}", 400, NOT_JSON),
    (LOGS % ONE + ",{}", 400, NOT_JSON),
    ("null", 400, NOT_OBJECT),
    ('"text"', 400, NOT_OBJECT),
    ("7", 400, NOT_OBJECT),
    ("[1]", 400, NOT_OBJECT),
    ("{}", 400, NOT_ARRAY),
    ('{"logs":null}', 400, NOT_ARRAY),
    ('{"logs":"[1]"}', 400, NOT_ARRAY),
    ('{"logs":{}}', 400, NOT_ARRAY),
    ('{"logs":[]}', 400, "'logs' must contain at least one entry"),
    (LOGS % ",".join([ONE] * 5000), 200, None),
    (LOGS % ",".join(["1"] * 5001), 400, "batch too large: 5001 entries (max 5000)"),
    (LOGS % "1,2", 400, "all entries rejected"),
    ((LOGS % ONE).ljust(8 * 1024 * 1024), 200, None),
    ((LOGS % ONE).ljust(8 * 1024 * 1024 + 1), 413, "request body is too large"),
]


def test_envelope_rules(batches):
    answers = acknowledge(judge_batches(batches(*[body for body, _, _ in ENVELOPES])))
    got = [(row["status"], row["error"]) for row in answers.orderBy("batch_id").collect()]
    assert got == [(status, error) for _, status, error in ENVELOPES]


def test_answer_of_a_mixed_batch(batches):
    body = envelope(entry(), entry(level="x"), entry(), entry(service=""), entry())
    verdicts = judge_batches(batches(body))
    (answer,) = acknowledge(verdicts).collect()
    assert (answer["status"], answer["error"], answer["accepted"]) == (200, None, 3)
    assert [tuple(r) for r in answer["rejected"]] == [(1, "invalid level: 'x'"), (3, SERVICE)]
    assert {row["index"] for row in rejected_entries(verdicts).collect()} == {1, 3}


def test_late_entries_are_rejected_one_by_one(batches):
    body = envelope(
        entry(), entry(timestamp="2031-07-22T00:00:00Z"), entry(timestamp="2031-06-12T00:00:00Z"),
    )
    (answer,) = acknowledge(judge_batches(batches(body))).collect()
    assert answer["accepted"] == 2
    assert [r["index"] if isinstance(r, dict) else r[0] for r in answer["rejected"]] == [2]
