"""Smaller pieces: older request forms, return values, literals, windowed counts."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keyloom.errors import ValidationError
from keyloom.expr import parse
from keyloom.expr.ast import literal, plain
from keyloom.expr.rewrite import legacy_update
from keyloom.model import TableDef
from keyloom.operators import drift, writes
from keyloom.streaming import live

T = TableDef("older", "pk")


def test_legacy_updates(spark):
    df = spark.createDataFrame([("a", 1, ["x"], [1], "gone")], "pk string, n int, tags array<string>, l array<int>, s string")
    made = legacy_update({
        "n": {"Action": "ADD", "Value": 4}, "tags": {"Action": "DELETE", "Value": {"x"}}, "l": {"Action": "ADD", "Value": [2]}, "s": {"Action": "DELETE"},
    }, T)
    out = writes.update(df, T, df.select("pk"), made)
    row = out.image("new").first()
    assert (row.n, row.tags, row.l, row.s) == (5, None, [1, 2], None)
    assert out.returned("UPDATED_OLD", ["n"]).first().asDict() == {"n": 1} and out.returned("NONE").count() == 0
    with pytest.raises(ValidationError):
        legacy_update({"pk": {"Value": "b"}}, T)
    with pytest.raises(ValidationError):
        out.returned("SOME")


def test_legacy_expected(spark):
    df = spark.createDataFrame([("a", 1)], "pk string, n int")
    new = spark.createDataFrame([("a", 2), ("b", 2)], "pk string, n int")
    kept = {r.pk: r.n for r in writes.put(df, T, new, expected={"n": {"Exists": False}}).table.collect()}
    assert kept == {"a": 1, "b": 2}
    with pytest.raises(ValidationError):
        parse.legacy_condition({"n": {"ComparisonOperator": "BETWEEN", "AttributeValueList": [1]}})


def test_literals():
    for value in ("x", True, None, b"ab", Decimal("1.5"), ["a", Decimal(1)], {"k": "v"}):
        assert plain(literal(value)) == value
    assert plain(literal({"M": {"a": {"L": [{"N": "1"}]}}})) == {"a": [Decimal(1)]}
    with pytest.raises(ValidationError):
        literal({"SS": ["a", "a"]})


def test_windowed_counts(spark):
    df = spark.createDataFrame([("t", "INSERT", 10), ("t", "INSERT", 20), ("t", "REMOVE", 4000)], "table_name string, event string, at int").withColumn("at", F.timestamp_seconds("at"))
    got = {(r.window.start.minute, r.event): r.n_changes for r in live.windowed_counts(df, "at", "1 hour").collect()}
    assert sorted(got.values()) == [1, 2]


def test_large_tables_are_few(spark):
    rows = [(f"t{i}", f"f{i % 2}", "2025-01-01", i, i, '{"pk":{"S":"a"}}') for i in range(200)] + [("big", "f", "2025-01-01", 500 + i, i, '{"pk":{"S":"a"}}') for i in range(100)]
    df = spark.createDataFrame(rows, "table_name string, file_name string, exported_at string, line_id int, line_no int, item_json string")
    assert drift.large_tables(df) == ["big"]
