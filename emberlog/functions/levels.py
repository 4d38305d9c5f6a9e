"""Severity names and their ascending codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberlog.schema import LEVELS


def encode_level(name: Column) -> Column:
    """Code of a severity name; null for anything that is not one of the four."""
    code = F.lit(None).cast("smallint")
    for position, level in reversed(list(enumerate(LEVELS))):
        code = F.when(name == level, F.lit(position).cast("smallint")).otherwise(code)
    return code


def decode_level(code: Column) -> Column:
    """Name of a severity code; an unknown code is an error, not a null."""
    unknown = F.raise_error(F.concat(F.lit("unknown log level code: "), code.cast("string")))
    name = unknown.cast("string")
    for position, level in reversed(list(enumerate(LEVELS))):
        name = F.when(code == position, level).otherwise(name)
    return F.when(code.isNotNull(), name)


def severity_at_least(code: Column, level: str) -> Column:
    return code >= F.lit(LEVELS.index(level)).cast("smallint")
