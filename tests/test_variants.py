"""Texts of JSON values in messages, at any depth."""

import pytest
from pyspark.sql import functions as F

from emberlog.functions.variants import display_text


@pytest.mark.parametrize("json, text", [
    ("[[[1,2]]]", "1,2"), ("[]", ""), ("[[],1]", ",1"), ("[[[[]]]]", ""),
    ('[null,[null,"a,b"],{"x":[1]},true]', ",,a,b,[object Object],true"),
    ('[["[x]","{"],1.50,1e21]', "[x],{,1.5,1e+21"), ('["a\\"b"]', 'a"b'),
    ('[{"a":[{"b":2}]},3]', "[object Object],3"), ("null", "null"), ("7", "7"), ('"q"', "q"),
])
def test_display_text(spark, json, text):
    frame = spark.createDataFrame([(json,)], "j string")
    assert frame.select(display_text(F.try_parse_json("j"))).first()[0] == text
