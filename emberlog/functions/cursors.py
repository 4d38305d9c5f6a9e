"""Page cursors as opaque tokens: a position ``(timestamp, id)`` in base64url JSON."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column, functions as F

from emberlog.functions.times import from_millis, iso_millis, iso_text, millis_text, text_millis
from emberlog.functions.variants import (
    is_number,
    named_fields,
    parse_json,
    string_value,
    type_name,
)

# Token version and the shape of an id.
CURSOR_VERSION = 1
ID_SHAPE = r"^\d{1,19}\z"


def encode_cursor(timestamp: Column, id_: Column) -> Column:
    text = F.concat(
        F.lit(f'{{"v":{CURSOR_VERSION},"ts":"'),
        iso_text(timestamp),
        F.lit('","id":"'),
        id_.cast("string"),
        F.lit('"}'),
    )
    # base64 breaks lines at 76 characters and pads; the token does neither.
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_")


def decode_cursor(token: Column) -> Column:
    """``struct<timestamp, id>`` of a token; null when the token is not valid."""
    raw = F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64"))
    fields = named_fields(parse_json(raw.cast("string")), "v", "ts", "id")
    version = fields["v"]
    version_ok = is_number(type_name(version)) & (
        F.try_variant_get(version, "$", "double") == CURSOR_VERSION
    )
    id_text = string_value(fields["id"])
    id_value = F.when(id_text.rlike(ID_SHAPE), id_text.try_cast("bigint"))
    millis = iso_millis(string_value(fields["ts"]))
    valid = version_ok & id_value.isNotNull() & millis.isNotNull()
    return F.when(
        valid, F.struct(from_millis(millis).alias("timestamp"), id_value.alias("id"))
    )


def token_of(millis: int, id_: int) -> str:
    """The token of one position, for a page already fetched."""
    text = json.dumps(
        {"v": CURSOR_VERSION, "ts": millis_text(millis), "id": str(id_)}, separators=(",", ":")
    )
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def position_of(token: object) -> tuple[int, int]:
    """``(millis, id)`` of one token given as a query argument."""
    try:
        padded = token + "=" * (-len(token) % 4)
        payload = json.loads(base64.b64decode(padded, altchars=b"-_", validate=True))
        version, id_text, millis = payload["v"], payload["id"], text_millis(payload["ts"])
        known = version == CURSOR_VERSION and not isinstance(version, bool)
        if known and millis is not None and re.fullmatch(r"[0-9]{1,19}", id_text):
            if int(id_text) < 2**63:
                return millis, int(id_text)
    except (ValueError, TypeError, KeyError):
        pass
    raise ValueError("invalid cursor")
