import datetime as dt
import random

import pytest

from caseloom.operators.dedupe import first_per_key, split_last_per_key
from caseloom.operators.intervals import point_in_interval
from caseloom.operators.joins import anti, fallback_join, flag_exists, lookup, null_if_missing_in, semi

DAY = dt.date(2021, 1, 1)


def _d(days):
    return DAY + dt.timedelta(days=days)


def _t(days, hours=0.0):
    return dt.datetime(2021, 1, 1) + dt.timedelta(days=days, hours=hours)


def test_interval_bounds_are_strict(spark):
    intervals = spark.createDataFrame([("a", _d(0), _d(5)), ("a", _d(10), None), ("c", _d(0), _d(1))], "k string, s date, e date")
    points = [
        ("a", _t(0)), ("a", _t(1)), ("a", _t(1, 0.001)), ("a", _t(2)), ("a", _t(4, 23.9)), ("a", _t(5)),
        ("a", _t(12)), ("b", _t(2)), (None, _t(2)), ("c", _t(1)), ("a", None),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, k string, at timestamp_ntz")
    got = {r["id"]: r["inside"] for r in point_in_interval(df, intervals, "k", "at", "s", "e").collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False, 9: False, 10: False}


def test_overlaps_give_earliest_start_and_end_of_latest_start(spark):
    intervals = spark.createDataFrame([("a", _d(0), _d(30)), ("a", _d(5), _d(12)), ("a", _d(5), _d(11))], "k string, s date, e date")
    df = spark.createDataFrame([("a", _t(8)), ("a", _t(20))], "k string, at timestamp_ntz")
    rows = point_in_interval(df, intervals, "k", "at", "s", "e").orderBy("at").collect()
    assert [(r["s"], r["e"]) for r in rows] == [(_d(0), _d(12)), (_d(0), _d(30))]


@pytest.mark.parametrize("seed,longest", [(1, 10), (2, 90), (3, 4000)])
def test_intervals_equal_brute_force(spark, seed, longest):
    rng = random.Random(seed)
    spans = []
    for _ in range(60):
        s = rng.randrange(-50, 5000)
        spans.append((rng.choice("aaab"), _d(s), _d(s + rng.randrange(0, longest))))
    points = [(i, rng.choice("aabc"), _t(rng.randrange(0, 5000), rng.choice([0, 0, 0.5, 12]))) for i in range(300)]
    out = point_in_interval(
        spark.createDataFrame(points, "id int, k string, at timestamp_ntz"),
        spark.createDataFrame(spans, "k string, s date, e date"),
        "k", "at", "s", "e",
    )
    got = {r["id"]: (r["s"], r["e"], r["inside"]) for r in out.collect()}
    assert len(got) == 300
    for i, key, at in points:
        hits = [
            (s, e) for k, s, e in spans
            if k == key and dt.datetime(s.year, s.month, s.day) + dt.timedelta(days=1) < at < dt.datetime(e.year, e.month, e.day)
        ]
        want = (min(hits)[0], max(hits)[1], True) if hits else (None, None, False)
        assert got[i] == want


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 5, "n"), (None, 6, "m"), ("b", 3, "z")], "k string, o int, v string")
    assert {r["v"] for r in first_per_key(df, ["k"], ["o"]).collect()} == {"x", "n", "z"}
    last, rest = split_last_per_key(df, ["k"], ["o"])
    assert {r["v"] for r in last.collect()} == {"y", "m", "z"}
    assert sorted(map(tuple, last.unionByName(rest).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_existence_and_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("a", 10), ("a", 10), (None, 7)], "k string, v int")
    assert [r["id"] for r in semi(df, dim, "k").collect()] == [1]
    assert sorted(r["id"] for r in anti(df, dim, "k").collect()) == [2, 3]
    assert {r["id"]: r["has"] for r in flag_exists(df, dim, "k", "has").collect()} == {1: True, 2: False, 3: False}
    assert {r["id"]: r["v"] for r in lookup(df, dim.distinct(), "k", "v", 0).collect()} == {1: 10, 2: 0, 3: 0}
    assert {r["id"]: r["k"] for r in null_if_missing_in(df, "k", dim, "k").collect()} == {1: "a", 2: None, 3: None}


def test_fallback_join_uses_second_key_and_fans_out(spark):
    dim = spark.createDataFrame(
        [("p1", "911", "911 I", "g1"), ("p2", "911", "911 II", "g2"), ("p2", "911", "911 II", "g2")],
        "ptype string, line string, series string, grp string",
    )
    df = spark.createDataFrame([(1, "p1", "911"), (2, "zz", "911"), (3, None, "000"), (4, None, None)], "id int, t string, vin_line string")
    out = fallback_join(df, dim, "t", "ptype", "vin_line", "line", ["line", "series"])
    got = sorted((r["id"], r["t"], r["ptype"], r["line"], r["series"], r["grp"]) for r in out.filter("id < 3").collect())
    assert got[0] == (1, "p1", "p1", "911", "911 I", "g1")
    assert sorted(g[4] for g in got[1:]) == ["911 I", "911 II"]
    assert all(g[1] is None and g[2] is None and g[5] is None for g in got[1:])
    assert out.filter("id >= 3").filter("line is not null").count() == 0
