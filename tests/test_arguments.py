import pytest

from emberlog import arguments as args
from emberlog.functions.cursors import position_of, token_of
from emberlog.functions.times import millis_text, text_millis


@pytest.mark.parametrize("given, words", [
    ({"service": ["a", "b"]}, "'service' must be a single value"),
    ({"level": ["info", "warn"]}, "'level' must be a single value"),
    ({"q": ["a", "b"]}, "'q' must be a single value"),
    ({"since": ["a", "b"]}, "'since' must be a single value"),
    ({"attr.k": ["a", "b"]}, "attribute filter 'attr.k' must be a single value"),
    ({"service": ""}, "'service' must be a non-empty string"),
    ({"service": "s" * 513}, "'service' filter is too long"),
    ({"level": "critical"}, "invalid level: 'critical'"),
    ({"since": "yesterday"}, "invalid since timestamp: 'yesterday'"),
    ({"until": "2026-13-01T00:00:00Z"}, "invalid until timestamp: '2026-13-01T00:00:00Z'"),
    ({"since": "2026-01-01T00:00:00Z", "until": "2026-01-01T00:00:00Z"},
     "'until' must be after 'since'"),
    ({"q": "x" * 1025}, "'q' filter is too long"),
    ({"attr.": "v"}, "invalid attribute key: ''"),
    ({"attr.a b": "v"}, "invalid attribute key: 'a b'"),
    ({"attr." + "k" * 129: "v"}, f"invalid attribute key: '{'k' * 129}'"),
    ({"attr.k": "v" * 1025}, "attribute value for 'attr.k' is too long"),
    ({f"attr.k{i}": "v" for i in range(40)}, "too many attribute filters (max 32)"),
])
def test_refused_filters(given, words):
    with pytest.raises(ValueError) as refusal:
        args.parse_filter(given)
    assert str(refusal.value) == words


def test_accepted_filters():
    wanted = args.parse_filter({
        "service": "s" * 512, "level": "warn", "q": "", "attr.a-b.c_D": "",
        "since": "2026-01-01T00:00:00+02:00", "until": "2999-01-01T00:00:00.1239Z",
    })
    assert wanted.level == 2 and wanted.q is None and wanted.attributes == {"a-b.c_D": ""}
    assert millis_text(wanted.since) == "2025-12-31T22:00:00.000Z"
    assert millis_text(wanted.until) == "2999-01-01T00:00:00.123Z"
    assert args.parse_filter({f"attr.k{i}": "v" for i in range(32)}).attributes


@pytest.mark.parametrize("text", ["1", "100", "999", "1000"])
def test_accepted_limits(text):
    assert args.parse_limit({"limit": text}) == int(text)


@pytest.mark.parametrize("text", ["-5", "abc", "10.5", "1e3", " 100", "0x64", ""])
def test_refused_limits(text):
    with pytest.raises(ValueError, match="invalid limit"):
        args.parse_limit({"limit": text})


@pytest.mark.parametrize("text", ["0", "1001"])
def test_limits_out_of_range(text):
    with pytest.raises(ValueError) as refusal:
        args.parse_limit({"limit": text})
    assert str(refusal.value) == f"limit out of range: {text} (must be 1..1000)"


def test_default_limit():
    assert args.parse_limit({}) == 100


@pytest.mark.parametrize("token", ["2h", "30s", "1w", "1M", "1y", "10m", "h", "", "constructor"])
def test_refused_buckets(token):
    with pytest.raises(ValueError) as refusal:
        args.parse_bucket({"bucket": token})
    assert str(refusal.value) == f"invalid bucket: '{token}' (must be one of 1m, 5m, 1h, 1d)"


def test_bucket_and_group_arguments():
    widths = [args.parse_bucket({"bucket": t}) for t in ("1m", "5m", "1h", "1d")]
    assert widths == [60_000_000, 300_000_000, 3_600_000_000, 86_400_000_000]
    with pytest.raises(ValueError, match="'bucket' must be one of 1m, 5m, 1h, 1d"):
        args.parse_bucket({})
    assert args.parse_group_by({}) is None and args.parse_group_by({"group_by": "level"}) == "level"
    with pytest.raises(ValueError, match="invalid group_by: 'host'"):
        args.parse_group_by({"group_by": "host"})
    with pytest.raises(ValueError, match="'until' is required"):
        args.require_range(args.parse_filter({"since": "2026-01-01T00:00:00Z"}))


def test_cursor_tokens():
    position = (text_millis("2026-03-09T04:17:22.081Z"), 9_223_372_036_854_775_807)
    token = token_of(*position)
    assert not set(token) & set("+/=") and position_of(token) == position


@pytest.mark.parametrize("token", [
    "", "!!!", None, 5, ["a"], "bm90IGpzb24", "W10", "bnVsbA",
    "eyJ2IjoyLCJ0cyI6IjIwMjYtMDgtMTFUMTE6NTk6MDAuMDAwWiIsImlkIjoiMSJ9",
    "eyJ2IjoxLCJ0cyI6Im5vdCBhIGRhdGUiLCJpZCI6IjEifQ",
    "eyJ2IjoxLCJ0cyI6IjIwMjYtMDgtMTFUMTE6NTk6MDAuMDAwWiIsImlkIjoxfQ",
])
def test_refused_cursors(token):
    with pytest.raises(ValueError, match="invalid cursor"):
        position_of(token)


def test_times():
    assert text_millis("1970-01-01T00:00:00.999Z") == 999
    assert millis_text(text_millis("2026-02-30T00:00:00Z")) == "2026-03-02T00:00:00.000Z"
    assert millis_text(text_millis("2026-12-31T24:00:00.000Z")) == "2027-01-01T00:00:00.000Z"
    assert text_millis("0000-01-01T00:00:00Z") == -62_167_219_200_000
    for text in ("2026-01-01T24:00:00.001Z", "2026-01-01T00:60:00Z", "2026-01-00T00:00:00Z",
                 "2026-01-01T00:00:00+24:00", "2026-01-01T00:00:00Z\n"):
        assert text_millis(text) is None
