"""Lookups in the flat string attributes of a log row."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F


def attribute(attributes: Column, key: str) -> Column:
    return attributes[key]


def has_attributes(attributes: Column, wanted: dict[str, str]) -> Column:
    """Whether every wanted key is present with exactly the wanted text."""
    checks = [attribute(attributes, key) == value for key, value in wanted.items()]
    return reduce(and_, checks, F.lit(True))


def first_attribute_key(attributes: Column) -> Column:
    """The first key, shorter keys before longer ones, then in byte order."""
    keys = F.transform(
        F.map_keys(attributes),
        lambda key: F.struct(F.octet_length(key).alias("size"), key.alias("key")),
    )
    return F.array_min(keys)["key"]
