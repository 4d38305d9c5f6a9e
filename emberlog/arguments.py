"""Checks of query arguments; every refusal is a ``ValueError`` with a fixed text.

Arguments arrive as a mapping of names to texts, the way a query string reads. A
list stands for an argument given more than once.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from emberlog.functions.cursors import position_of
from emberlog.functions.times import BUCKET_MICROS, text_millis
from emberlog.schema import LEVELS

# Argument limits.
MAX_SERVICE_LENGTH = 512
MAX_SEARCH_LENGTH = 1_024
MAX_ATTRIBUTE_VALUE_LENGTH = 1_024
MAX_ATTRIBUTE_FILTERS = 32
ATTRIBUTE_KEY = r"[A-Za-z0-9_.\-]{1,128}"
ATTRIBUTE_PREFIX = "attr."
DEFAULT_LIMIT = 100
MAX_LIMIT = 1_000


@dataclass(frozen=True)
class LogFilter:
    """Filters shared by listing and counting; times are milliseconds."""

    service: str | None = None
    level: int | None = None
    since: int | None = None
    until: int | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)
    q: str | None = None


def _utf16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _single(arguments: Mapping[str, object], name: str, label: str | None = None) -> str | None:
    value = arguments.get(name)
    if value is None or isinstance(value, str):
        return value
    raise ValueError(f"{label or repr(name)} must be a single value")


def _time(arguments: Mapping[str, object], name: str) -> int | None:
    text = _single(arguments, name)
    if text is None:
        return None
    millis = text_millis(text)
    if millis is None:
        raise ValueError(f"invalid {name} timestamp: '{text}'")
    return millis


def parse_filter(arguments: Mapping[str, object]) -> LogFilter:
    service = _single(arguments, "service")
    if service is not None and not service:
        raise ValueError("'service' must be a non-empty string")
    if service is not None and _utf16(service) > MAX_SERVICE_LENGTH:
        raise ValueError("'service' filter is too long")

    level = _single(arguments, "level")
    if level is not None and level not in LEVELS:
        raise ValueError(f"invalid level: '{level}'")

    since, until = _time(arguments, "since"), _time(arguments, "until")
    if since is not None and until is not None and until <= since:
        raise ValueError("'until' must be after 'since'")

    q = _single(arguments, "q")
    if q is not None and _utf16(q) > MAX_SEARCH_LENGTH:
        raise ValueError("'q' filter is too long")

    return LogFilter(
        service=service,
        level=None if level is None else LEVELS.index(level),
        since=since,
        until=until,
        attributes=_attribute_filters(arguments),
        q=q or None,
    )


def _attribute_filters(arguments: Mapping[str, object]) -> dict[str, str]:
    wanted: dict[str, str] = {}
    for name in arguments:
        if not name.startswith(ATTRIBUTE_PREFIX):
            continue
        key = name[len(ATTRIBUTE_PREFIX):]
        if not re.fullmatch(ATTRIBUTE_KEY, key):
            raise ValueError(f"invalid attribute key: '{key}'")
        value = _single(arguments, name, f"attribute filter '{name}'")
        if value is None:
            continue
        if _utf16(value) > MAX_ATTRIBUTE_VALUE_LENGTH:
            raise ValueError(f"attribute value for '{name}' is too long")
        wanted[key] = value
        if len(wanted) > MAX_ATTRIBUTE_FILTERS:
            raise ValueError(f"too many attribute filters (max {MAX_ATTRIBUTE_FILTERS})")
    return wanted


def parse_limit(arguments: Mapping[str, object]) -> int:
    text = _single(arguments, "limit")
    if text is None:
        return DEFAULT_LIMIT
    if not re.fullmatch(r"[0-9]+", text):
        raise ValueError(f"invalid limit: '{text}'")
    limit = int(text)
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit out of range: {limit} (must be 1..{MAX_LIMIT})")
    return limit


def parse_cursor(arguments: Mapping[str, object]) -> tuple[int, int] | None:
    token = arguments.get("cursor")
    return None if token is None else position_of(token)


def require_range(wanted: LogFilter) -> None:
    for name in ("since", "until"):
        if getattr(wanted, name) is None:
            raise ValueError(f"'{name}' is required")


def parse_bucket(arguments: Mapping[str, object]) -> int:
    """Width in microseconds of a bucket token."""
    tokens = ", ".join(BUCKET_MICROS)
    token = arguments.get("bucket")
    if not isinstance(token, str):
        raise ValueError(f"'bucket' must be one of {tokens}")
    if token not in BUCKET_MICROS:
        raise ValueError(f"invalid bucket: '{token}' (must be one of {tokens})")
    return BUCKET_MICROS[token]


def parse_group_by(arguments: Mapping[str, object]) -> str | None:
    group_by = arguments.get("group_by")
    if group_by not in (None, "service", "level"):
        raise ValueError(f"invalid group_by: '{group_by}' (must be 'service' or 'level')")
    return group_by
