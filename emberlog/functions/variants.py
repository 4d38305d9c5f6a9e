"""JSON values of unknown shape: strict parsing, type tests, text forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INTEGER_TEXT_LIMIT = 1e21
FRACTION_TEXT_LIMIT = 1e-6
JSON_TOKEN = r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\[\]{},:"\s]+'


def wrapped_values(text: Column) -> Column:
    """Values of the text inside ``[ ]``; null when that is not JSON."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")


def is_whole(text: Column) -> Column:
    """Whether the text also reads as JSON inside ``{ }``."""
    return F.json_object_keys(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()


def single_value(wrapped: Column, whole: Column) -> Column:
    """The one JSON value a text holds, or null.

    The parser stops silently at the end of the first value. Inside ``[ ]`` only
    a closing bracket can end it early and inside ``{ }`` only a closing brace,
    so a text that is complete in both wrappings holds one value and no more.
    """
    return F.when((F.size(wrapped) == 1) & whole, F.get(wrapped, F.lit(0)))


def parse_json(text: Column) -> Column:
    return single_value(wrapped_values(text), is_whole(text))


def named_fields(value: Column, *names: str) -> Column:
    """Struct of some fields of a JSON object; null for every other value. A
    field is null when absent and a JSON null when present and null."""
    return F.try_variant_get(value, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")


def object_fields(value: Column) -> Column:
    """Fields of a JSON object; null for every other value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def array_items(value: Column) -> Column:
    """Items of a JSON array; null for every other value."""
    return F.try_variant_get(value, "$", "array<variant>")


def type_name(value: Column) -> Column:
    return F.schema_of_variant(value)


def string_value(value: Column) -> Column:
    """The text of a JSON string; null for every other value."""
    return F.when(type_name(value) == "STRING", value.cast("string"))


def is_number(type_: Column) -> Column:
    return type_.isin("BIGINT", "DOUBLE") | type_.startswith("DECIMAL")


def number_text(value: Column, type_: Column) -> Column:
    """A JSON number as text, in the shortest decimal form.

    Whole numbers below 1e21 are written out, fractions down to 1e-6 too; beyond
    that the form is ``1.5e+21`` or ``1.5e-7``. Whole numbers keep all digits.
    """
    text = value.cast("string")
    number = F.try_variant_get(value, "$", "double")
    size = F.abs(number)
    digits = F.length(F.regexp_replace(text, "^[-.0]+|[^0-9]", ""))

    exponent = number.cast("string")
    exponent = F.regexp_replace(exponent, r"\.0E", "E")
    exponent = F.regexp_replace(exponent, r"E(\d)", "e+$1")
    exponent = F.regexp_replace(exponent, "E-", "e-")

    whole = F.when(type_ == "DOUBLE", number.cast("decimal(38,0)").cast("string")).otherwise(text)
    written = number.cast("decimal(38,22)").cast("string")
    written = F.regexp_replace(written, r"\.?0+\z", "")
    fraction = F.when((type_ != "DOUBLE") & (digits <= 15), text).otherwise(written)

    return (
        F.when(type_ == "BIGINT", text)
        .when(size == 0, "0")
        .when((size >= INTEGER_TEXT_LIMIT) | (size < FRACTION_TEXT_LIMIT), exponent)
        .when(size == F.rint(size), whole)
        .otherwise(fraction)
    )


def scalar_text(value: Column, type_: Column) -> Column:
    """A JSON string, number or boolean as text."""
    return F.when(is_number(type_), number_text(value, type_)).otherwise(value.cast("string"))


def display_text(value: Column) -> Column:
    """Any JSON value as it reads in a message: absent is ``undefined``, an
    object is ``[object Object]``, an array is its items joined by commas with
    nulls left empty, and so are arrays in it, however deep."""

    def item_text(item: Column) -> Column:
        type_ = type_name(item)
        return (
            F.when(type_ == "VOID", "")
            .when(type_.startswith("OBJECT"), "[object Object]")
            .otherwise(scalar_text(item, type_))
        )

    # The leaves of an array in its JSON text: strings, runs of other characters,
    # and the marks between them. Marks at depth 0 of any object part leaves.
    tokens = F.regexp_extract_all(F.to_json(value), F.lit(JSON_TOKEN), F.lit(0))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("[").alias("before"), F.array().cast("array<string>").alias("leaves")
    )

    def step(state: Column, token: Column) -> Column:
        opened, closed = token == "{", token == "}"
        depth = state["depth"] + opened.cast("int") - closed.cast("int")
        inside = state["depth"] > 0
        mark = token.isin("[", "]", ",")
        # An empty place reads as an empty text: an empty array, which is one
        # leaf without text.
        leaf = (
            F.when(inside, F.lit(None))
            .when(opened, F.lit('{}'))
            .when((token == "]") & (state["before"] == "["), F.lit(""))
            .when(mark, F.lit(None))
            .otherwise(token)
        )
        leaves = F.when(leaf.isNull(), state["leaves"]).otherwise(F.concat(state["leaves"], F.array(leaf)))
        return F.struct(
            depth.alias("depth"),
            F.when(inside, state["before"]).otherwise(token).alias("before"),
            leaves.alias("leaves"),
        )

    leaves = F.aggregate(tokens, start, step, lambda state: state["leaves"])
    deep = F.array_join(
        F.transform(leaves, lambda leaf: F.when(leaf == "", "").otherwise(item_text(F.try_parse_json(leaf)))), ","
    )
    return (
        F.when(value.isNull(), "undefined")
        .when(type_name(value) == "VOID", "null")
        .when(type_name(value).startswith("ARRAY"), deep)
        .otherwise(item_text(value))
    )
