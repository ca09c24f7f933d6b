"""F1, F2, F3, F6 on hand-made edge rows (FIXTURES.md §4)."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions import labels


def test_clean_target(spark):
    vals = [None, "None", "nan", "NaN", "none", "200.0", "A"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r[0] for r in df.select(labels.clean_target("t")).collect()]
    assert got == ["NOT_APPLICABLE"] * 4 + ["none", "200.0", "A"]


def test_float_string_label(spark):
    vals = ["200.0", "200", "4.5", "abc", "inf", "nan", None, "1e3", " 7.0 ", "-3.0", "1e30"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(labels.float_string_label("s")).collect()]
    assert got == ["200", "200", "4.5", "abc", "inf", "nan", None, "1000", "7", "-3", "1e30"]


def test_clean_records(spark):
    df = spark.createDataFrame([("NaN", "none", "TRUE"), ("x", "12.5", "false"), ("None", "abc", "maybe")],
                               "c string, n string, b string")
    out = labels.clean_records(df, categorical=("c",), numeric=("n",), boolean=("b",)).collect()
    assert [tuple(r) for r in out] == [(None, None, True), ("x", 12.5, False), (None, None, None)]


def test_day_distance_floors_before_abs(spark):
    q = dt.datetime(2024, 1, 10, 12, 0)
    rows = [(q, dt.datetime(2024, 1, 10, 0, 0)), (q, dt.datetime(2024, 1, 11, 0, 0)),
            (q, dt.datetime(2024, 1, 7, 12, 0))]
    df = spark.createDataFrame(rows, "q timestamp, t timestamp")
    got = [r[0] for r in df.select(labels.day_distance("t", "q")).collect()]
    # t 12 h earlier -> floor(-0.5) = -1 -> 1 day; 12 h later -> floor(0.5) = 0
    assert got == [1, 0, 3]
