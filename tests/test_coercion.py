"""The dynamic-value table: Number(x), String(x) as JavaScript."""

import math

import pytest
from pyspark.sql import functions as F

from routelytics.functions.coercion import (js_number, js_string, number_to_js_string,
                                            string_to_number)


@pytest.mark.parametrize("text,expected", [
    ("", 0.0), ("   ", 0.0), ("12", 12.0), (" 12 ", 12.0), ("0x10", 16.0), ("1d", None),
    ("12f", None), ("1e3", 1000.0), (".5", 0.5), ("abc", None), ("Infinity", math.inf), ("-7", -7.0),
])
def test_string_to_number(spark, text, expected):
    got = spark.createDataFrame([(text,)], "s string").select(string_to_number("s").alias("n")).collect()[0].n
    if expected is None:
        assert math.isnan(got)
    else:
        assert got == expected
    py = js_number(text)
    assert (math.isnan(py) and expected is None) or py == expected


def test_null_is_missing(spark):
    got = spark.createDataFrame([(None,)], "s string").select(string_to_number("s").alias("n")).collect()[0].n
    assert math.isnan(got)


@pytest.mark.parametrize("x,expected", [
    (75000.0, "75000"), (0.5, "0.5"), (1e7, "10000000"), (1.5e-8, "1.5e-8"), (1e21, "1e+21"),
    (-3.25, "-3.25"), (0.0, "0"), (123456789.125, "123456789.125"), (0.001, "0.001"),
])
def test_number_to_string(spark, x, expected):
    got = spark.createDataFrame([(x,)], "x double").select(number_to_js_string("x").alias("s")).collect()[0].s
    assert got == expected
    assert js_string(x) == expected


def test_literal_helpers():
    assert js_number(True) == 1.0 and js_number(None) == 0.0
    assert js_string(100000) == "100000" and js_string(0.95) == "0.95" and js_string(None) == "null"
