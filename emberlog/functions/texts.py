"""Text rules: lengths, literal substring search, first long word."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters that separate words.
WORD_SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def longer_than(text: Column, limit: int) -> Column:
    """Whether the UTF-16 length passes ``limit``. A text never has more UTF-16
    units than UTF-8 bytes, so short texts are settled without re-encoding."""
    return F.when(F.octet_length(text) <= limit, False).otherwise(utf16_length(text) > limit)


def contains_text(text: Column, part: str) -> Column:
    """Case-insensitive search for a literal part; no character is special."""
    return F.contains(F.lower(text), F.lower(F.lit(part)))


def first_long_word(text: Column, length: int = 4) -> Column:
    """First word of at least ``length`` characters, reduced to letters and
    digits; null when there is none or too little of it is left."""
    word = F.regexp_extract(text, f"[^{WORD_SPACE}]{{{length},}}", 0)
    plain = F.regexp_replace(word, "[^A-Za-z0-9]", "")
    return F.when(F.length(plain) >= length, plain)
