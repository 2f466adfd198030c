import json

import pytest
from pyspark.sql import functions as F

from weftline.functions.paths import blanked, fill, identifier, label
from weftline.functions.records import key_of, overlay, property_of, record, without_id


def one(spark, schema, values, column):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "value, key",
    [("1", "1"), ("1.0", "1"), ("1e0", "1"), ('"1"', '"1"'), ("1.5", "1.5"), ("true", "true"), ("null", None), (None, None), ("9007199254740993", "9007199254740993"), ("0", "0"), ('""', '""')],
)
def test_keys_tell_types_apart(spark, value, key):
    text = "{}" if value is None else f'{{"id": {value}}}'
    assert one(spark, "t string", (text,), key_of(property_of(record(F.col("t")), "id"))) == key


@pytest.mark.parametrize(
    "base, item, dictionary, want",
    [
        ({"id": 9, "t": "old", "keep": 1}, {"id": 1, "n": "new"}, {"n": "t"}, {"id": 9, "t": "new", "keep": 1}),
        ({"t": "old"}, {"id": 1}, {"n": "t"}, {}),
        ({"t": "old"}, {"n": None}, {"n": "t"}, {"t": None}),
        (None, {"n": 1}, {"n": "t"}, {"t": 1}),
        ({}, {"a": 1, "b": 2}, {"a": "x", "b": "x"}, {"x": 2}),
        ({"x": 0}, {"a": 1}, {"a": "x", "b": "x"}, {}),
        ({"id": 9}, {"id": 1}, {"id": "id"}, {"id": 9}),
        ({"id": 9}, {"key": 1}, {"key": "id"}, {"id": 1}),
        ({"a": 1}, {"n": 1, "m": 2, "o": 3, "p": 4}, {"n": None, "m": "", "o": "null", "p": "undefined"}, {"a": 1}),
    ],
)
def test_overlay(spark, base, item, dictionary, want):
    texts = [None if x is None else json.dumps(x) for x in (base, item)]
    mapped = F.to_json(overlay(record(F.col("base")), record(F.col("item")), F.col("dict")))
    got = one(spark, "base string, item string, dict map<string,string>", (*texts, dictionary), mapped)
    assert json.loads(got) == want


def test_overlay_again_changes_nothing_and_create_drops_the_id(spark):
    twice = lambda b, i, d: overlay(overlay(b, i, d), i, d)
    args = record(F.col("b")), record(F.col("i")), F.create_map(F.lit("n"), F.lit("t"))
    row = spark.createDataFrame([('{"id": 3, "t": 1}', '{"n": 2}')], "b string, i string")
    got = row.select(F.to_json(overlay(*args)).alias("x"), F.to_json(twice(*args)).alias("y"), F.to_json(without_id(overlay(*args))).alias("z")).first()
    assert got.x == got.y and json.loads(got.z) == {"t": 2}


def test_paths(spark):
    filled = fill(F.lit("/a/{id}/{id}/{x-y}/{z}"), F.array(F.lit("id"), F.lit("x-y"), F.lit("none"), F.lit("z")), F.create_map(F.lit("id"), F.lit("$&"), F.lit("x-y"), F.lit("{z}")))
    row = spark.range(1).select(filled, identifier(F.lit("patch"), F.lit("/p")), label(F.lit("i"), F.lit(None).cast("string")), blanked(F.lit("GET /a/{user-id}/{b}"))).first()
    assert list(row) == ["/a/$&/{id}/undefined/{z}", "PATCH /p", "i - undefined", "GET /a/{}/{}"]
