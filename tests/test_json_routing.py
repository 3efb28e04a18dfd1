"""VARIANT path: the dynamic-value table of SURVEY 1.3 on raw JSON."""

import pytest
from pyspark.sql import functions as F

from routelytics.operators.routing import route_json

ROWS = {"a": '{"id":"a"}', "b": '{"id":"b","x":null}', "c": '{"id":"c","x":""}',
        "d": '{"id":"d","x":" 12 "}', "e": '{"id":"e","x":"0x10"}', "f": '{"id":"f","x":"1d"}',
        "g": '{"id":"g","x":75000}', "h": '{"id":"h","x":true}', "i": '{"id":"i","x":0.5}',
        "j": '{"id":"j","x":{}}', "k": '{"id":"k","x":"12"}'}


@pytest.mark.parametrize("op,value,expected", [
    ("lessThan", 10, {"b", "c", "h", "i"}),
    ("greaterThan", 11, {"d", "e", "g", "k"}),
    ("equals", 75000, {"g"}),
    ("equals", "12", {"k"}),
    ("equals", 12, set()),
    ("contains", "null", {"b"}),
    ("contains", "undefined", {"a"}),
    ("contains", "75000", {"g"}),
    ("contains", "true", {"h"}),
    ("contains", "object", {"j"}),
])
def test_dynamic_values(spark, op, value, expected):
    df = spark.createDataFrame([(k, v) for k, v in ROWS.items()], "key string, value string") \
        .withColumn("v", F.parse_json("value"))
    got = {r.key for r in route_json(df, [(1, "x", op, value, "urgent")]).collect() if r.matched_priority == 1}
    assert got == expected


def test_camel_field_reads_snake_key(spark):
    df = spark.createDataFrame([('{"id":"a","risk_score":0.97}',)], "value string") \
        .withColumn("v", F.parse_json("value"))
    assert route_json(df, [(1, "riskScore", "greaterThan", 0.95, "urgent")]).collect()[0].matched_priority == 1
