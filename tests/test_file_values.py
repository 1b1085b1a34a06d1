"""Values of JSON and CSV files with their places."""

import json

import pytest
from pyspark.sql import functions as F

from textward.operators import inspect as I
from textward.sources import files as FS

SCHEMA = "id long, ext string, content binary"


def values(spark, ext, content):
    df = spark.createDataFrame([(1, ext, None if content is None else bytearray(content))], SCHEMA)
    return [(r.row, r.path, r.value, r.error) for r in FS.file_values(df, "id").collect()]


def test_json_paths(spark):
    text = '{"a": [1.50, {"b c": "x", "d": null}], "a": true, "s": "", "n": 4111111111111111, "\\u00e9": "\\u00fc"}'
    assert values(spark, "json", text.encode()) == [
        (None, "$.a[0]", "1.50", None), (None, '$.a[1]["b c"]', "x", None), (None, "$.a", "true", None), (None, "$.s", "", None),
        (None, "$.n", "4111111111111111", None), (None, "$.é", "ü", None)]


@pytest.mark.parametrize("bad", ["", "{", "[" * 100_000, '{"a": 1} x'])
def test_json_that_cannot_be_read(spark, bad):
    assert values(spark, "json", bad.encode()) == [(None, None, None, "not JSON")]


def test_csv_cells(spark):
    text = '﻿name,mail\n"a ""b""\nc",x@example.com\n,,extra\n\nlast,\n'
    assert values(spark, "csv", text.encode()) == [
        (0, "name", "name", None), (0, "mail", "mail", None), (1, "name", 'a "b"\nc', None), (1, "mail", "x@example.com", None),
        (2, "column 3", "extra", None), (4, "name", "last", None)]
    assert values(spark, "csv", b"") == [] and values(spark, "csv", None) == [] and values(spark, "txt", b"a,b") == []


def test_long_cells_and_many_values(spark):
    big = "w " * 300_000
    assert values(spark, "csv", f"t\n{big}\n".encode())[1] == (1, "t", big, None)
    many = values(spark, "json", json.dumps(list(range(20_000))).encode())  # more than a batch
    assert [v for _, _, v, _ in many] == [str(i) for i in range(20_000)]


def test_findings_name_their_place(spark):
    df = spark.createDataFrame([
        (1, "json", bytearray(b'{"user": {"mail": "bob@example.org", "note": "none"}}')),
        (2, "csv", bytearray(b"who,ssn\nbob,123-45-6789\n")), (3, "csv", bytearray(b"alice@example.com\n"))], SCHEMA)
    found = I.entity_rows(FS.file_values(df, "id"), "id", "row", "path", text="value")
    rows = found.collect()
    assert {(r.id, r.row, r.path) for r in rows} == {(1, None, "$.user.mail"), (2, 1, "ssn"), (3, 0, "alice@example.com")}
    assert {(1, "email"), (2, "ssn"), (3, "email")} <= {(r.id, r.entity_type) for r in rows}


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert FS.file_values(df, "id").columns == ["id", "ext", "row", "path", "value", "error"] and FS.file_values(df, "id").count() == 0
    named = spark.createDataFrame([(7, "json", bytearray(b"[1]"), "x")], SCHEMA + ", text string").withColumn("error", F.lit("theirs"))
    assert FS.file_values(named, "id", "text").first()["text"] == "x"
