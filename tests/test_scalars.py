"""Column helpers, on the values users know them by."""

import pytest
from pyspark.sql import functions as F

from larder.functions import scalars
from larder.functions.calendar import order_calendar


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_epoch_text(spark):
    rows = [("1609459200",), (None,), ("NaN",), ("soon",), ("99999999999",), ("-1",)]
    got = values(spark, rows, "e string", scalars.unix_to_text("e"))
    assert [g[0] for g in got] == ["2021-01-01 00:00:00", None, None, None, None, "1969-12-31 23:59:59"]


def test_epoch_pattern(spark):
    assert values(spark, [(1609459200,)], "e long", scalars.unix_to_text("e", "yyyy/MM"))[0][0] == "2021/01"


def test_currency(spark):
    rows = [(1234.5,), (0.0,), (None,), (float("nan"),), (-1234567.891,)]
    got = values(spark, rows, "a double", scalars.format_currency("a"), scalars.format_currency("a", "EUR", 0))
    assert [g[0] for g in got] == ["1,234.50 DKK", "0.00 DKK", "0.00 DKK", "0.00 DKK", "-1,234,567.89 DKK"]
    assert got[0][1] == "1,234 EUR" and got[2][1] == "0.00 EUR"


def test_safe_division(spark):
    rows = [(10.0, 2.0), (10.0, 0.0), (10.0, float("nan")), (10.0, None), (None, 2.0)]
    got = values(spark, rows, "a double, b double", scalars.safe_division("a", "b"), scalars.safe_division("a", "b", -1))
    assert got == [(5.0, 5.0), (0.0, -1.0), (0.0, -1.0), (0.0, -1.0), (None, None)]


def test_clean_string(spark):
    rows = [("  Hello World  ",), (None,), ("\tÀ\n",), ("",)]
    assert [g[0] for g in values(spark, rows, "s string", scalars.clean_string("s"))] == ["hello world", "", "à", ""]


def test_hour_label(spark):
    got = values(spark, [(h,) for h in (0, 1, 11, 12, 13, 23)], "h int", scalars.hour_label("h"))
    assert [g[0] for g in got] == ["12am", "1am", "11am", "12pm", "1pm", "11pm"]


def test_flatten(spark):
    df = spark.createDataFrame([((1, (2, 3)), 4)], "a struct<b: int, c: struct<d: int, e: int>>, f int")
    assert scalars.flatten_record(df).columns == ["a_b", "a_c_d", "a_c_e", "f"]
    assert scalars.flatten_record(df, ".").columns == ["a.b", "a.c.d", "a.c.e", "f"]
    assert tuple(scalars.flatten_record(df).first()) == (1, 2, 3, 4)


def test_require_columns(spark):
    df = spark.range(1)
    assert scalars.require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="stock lacks columns: a, b"):
        scalars.require_columns(df, ["b", "id", "a"], "stock")


def test_finite(spark):
    rows = [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (1.5,)]
    assert [g[0] for g in values(spark, rows, "v double", scalars.finite("v"))] == [None, None, None, None, 1.5]


def test_attach(spark):
    df = scalars.attach(spark.range(3), s=spark.range(3).agg(F.max("id").alias("top"), F.min("id").alias("low")))
    assert [tuple(r) for r in df.select("id", "s.top", "s.low").orderBy("id").collect()] == [(0, 2, 0), (1, 2, 0), (2, 2, 0)]


def test_calendar(spark):
    # 2023-01-01 is a Sunday in ISO week 52, 2024-02-29 a Thursday.
    df = order_calendar(spark.createDataFrame([(1672531200,), (1709251199,), (None,)], "created long"))
    rows = [tuple(r) for r in df.select("hour", "day_of_week", "day_name", "month", "week_of_year", "is_weekend").collect()]
    assert rows[0] == (0, 6, "Sunday", 1, 52, 1)
    assert rows[1] == (23, 3, "Thursday", 2, 9, 0)
    assert rows[2] == (None,) * 6
