import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseloom import functions as X
from caseloom.operators.rows import drop_incomplete, reorder


def _one(spark, kind, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_dates(spark):
    values = ["1/2/2021", "01/02/2021", "20210201", "28/05/2921", "", "x", None]
    day = dt.date(2021, 2, 1)
    assert _one(spark, "string", values, X.parse_date("v")) == [day, day, day, None, None, None, None]


def test_times(spark):
    values = ["9:05", "09:05", "0", "00:00", "9:5", None, "123:00"]
    assert _one(spark, "string", values, X.normalise_time("v")) == ["09:05:00", "09:05:00", None, "00:00:00", None, None, None]
    at = X.at_time(F.lit("2021-02-01").cast("date"), "v")
    noon = dt.datetime(2021, 2, 1)
    assert _one(spark, "string", ["09:05", "24:10", "01:02:03", None], at) == [
        noon + dt.timedelta(hours=9, minutes=5),
        noon + dt.timedelta(days=1, minutes=10),
        noon + dt.timedelta(hours=1, minutes=2, seconds=3),
        None,
    ]


def test_days_are_floored_also_below_zero(spark):
    start = dt.datetime(2021, 1, 10)
    ends = [start + dt.timedelta(hours=h) for h in (-6, 0, 23, 24, 47)]
    days = X.floor_days(F.lit(start).cast("timestamp_ntz"), "v")
    assert _one(spark, "timestamp_ntz", ends, days) == [-1, 0, 0, 1, 1]
    minutes = X.minutes_between(F.lit(start).cast("timestamp_ntz"), "v")
    later = [start + dt.timedelta(seconds=s) for s in (-30, 0, 59, 60, 125)]
    assert _one(spark, "timestamp_ntz", later, minutes) == [None, None, None, 1, 2]


def test_flags(spark):
    values = ["yes", "NO", None, "N/A", "Yes"]
    assert _one(spark, "string", values, X.to_flag("v")) == [True, False, False, True, True]
    assert _one(spark, "string", values, X.to_flag("v", False)) == [True, False, False, False, True]
    assert _one(spark, "string", values, X.to_flag("v", None)) == [True, False, False, None, True]


def test_bins_are_closed_on_the_right(spark):
    values = [0, 50, 20000, 20001, 240000, 240001, 260000, 260001, None]
    want = [None, "0-20000", "0-20000", "20000-40000", "220000-240000", None, None, None, None]
    assert _one(spark, "long", values, X.bin_fixed("v", 0, 240_000, 20_000)) == want
    left = _one(spark, "double", [0.0, 19.9, 20.0, 40.0], X.bin_fixed("v", 0, 40, 20, right=False))
    assert left == ["0-20", "0-20", "20-40", None]


def test_guards(spark):
    assert _one(spark, "string", ["0", "00:00", "1", None], X.null_if("v", ["0", "00:00"])) == [None, None, "1", None]
    assert _one(spark, "double", [49.9, 50.0, 260000.0, 260000.1, None], X.null_outside("v", 50, 260_000)) == [
        None, 50.0, 260000.0, None, None,
    ]
    open_top = X.null_outside("v", hi=10, hi_inclusive=False)
    assert _one(spark, "int", [9, 10, -5], open_top) == [9, None, -5]
    assert _one(spark, "string", ["1", "9", None], X.map_values("v", {"1": "one"})) == ["one", "9", None]
    assert _one(spark, "string", ["1", "9"], X.map_values("v", {"1": "one"}, default=None)) == ["one", None]
    assert _one(spark, "string", ["1.5", "x", None], X.to_number("v")) == [1.5, None, None]
    assert _one(spark, "int", [None, 3], X.fill_from("v", F.col("i"), 7)) == [0, 3]


def test_end_must_follow_start(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2021, 1, 2), d(2021, 1, 1)), (d(2021, 1, 1), d(2021, 1, 1)), (d(2021, 1, 1), None)], "e date, s date")
    assert [r[0] for r in df.select(X.null_if_not_after("e", "s")).collect()] == [d(2021, 1, 2), None, d(2021, 1, 1)]


def test_contract_edges(spark):
    start, end = dt.date(2021, 1, 1), dt.date(2021, 12, 31)
    moments = [dt.datetime(2020, 12, 31), dt.datetime(2021, 1, 31), dt.datetime(2021, 1, 31, 1), dt.datetime(2021, 12, 1), dt.datetime(2022, 5, 5)]
    edge = X.near_contract_edge("v", F.lit(start), F.lit(end))
    assert _one(spark, "timestamp_ntz", moments, edge) == [False, True, False, True, True]
    unknown = X.near_contract_edge("v", F.lit(None).cast("date"), F.lit(None).cast("date"))
    assert _one(spark, "timestamp_ntz", moments, unknown) == [False] * 5


def test_row_sums_ignore_missing(spark):
    df = spark.createDataFrame([(True, None, 2), (None, None, None)], "a boolean, b boolean, c int")
    rows = df.select(X.row_sum(["a", "b", "c"]), X.row_mean(["a", "b", "c"])).collect()
    assert list(rows[0]) == pytest.approx([3, 1.0]) and list(rows[1]) == [0, 0.0]


def test_words_of_any_script(spark):
    assert _one(spark, "string", ["Tür öffnet-nicht; 42x", None], X.tokens("v")) == [["tür", "öffnet", "nicht", "42x"], None]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 5, None), (3, 6, "z")], "a int, b int, c string")
    assert reorder(df, ["c"]).columns == ["c", "a", "b"]
    kept, counts = drop_incomplete(df, ["b", "c"])
    assert kept.count() == 1
    assert counts.first().asDict() == {"kept": 1, "dropped": 2, "missing_b": 1, "missing_c": 1}
