"""Ordered scans give the same with and without slicing, whatever the group sizes."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.operators.asof import asof_join, asof_sweep
from caseloom.operators.ordered import SLICE, OrderedGroups
from caseloom.operators.quantiles import box_stats, quantiles
from caseloom.operators.sessions import assign_cases, assign_stays, flag_repeat

DAY = dt.datetime(2021, 1, 1)


def _calls(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", "d", None])
        ts = DAY + dt.timedelta(hours=rng.randrange(0, 24 * 400)) if rng.random() > 0.03 else None
        rows.append((i, key, ts, rng.choice(["tow", "jump", "cancel"]), rng.choice(["x", "y", None])))
    return spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, outcome string, stay string")


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("descending", [False, True])
def test_slices_do_not_change_results(spark, descending):
    df = _calls(spark)
    results = []
    for limit in (10**6, 7, 40):
        scan = OrderedGroups(df, ["key"], ["ts", "id"], descending=descending, max_group_rows=limit)
        assert scan.sliced == (limit < 10**6)
        scan = scan.previous(before="ts", outcome_before="outcome")
        scan = scan.running_sum("tows", (F.col("outcome") == "tow").cast("int"))
        scan = scan.last_known("stay_seen", "stay")
        out = scan.result()
        results.append(_rows(out, "id", "before", "outcome_before", "tows", "stay_seen"))
    assert results[0] == results[1] == results[2]


def test_hot_group_is_spread_over_slices(spark):
    df = _calls(spark, 3000)
    scan = OrderedGroups(df, ["key"], ["ts", "id"], max_group_rows=100)
    sizes = scan.df.groupBy("key", SLICE).count().toPandas()
    assert sizes["count"].max() <= 250
    assert sizes[sizes["key"] == "hot"].shape[0] >= 8


def _pandas_cases(df):
    pdf = df.toPandas()
    pdf["ts"] = pd.to_datetime(pdf["ts"])
    pdf = pdf.sort_values(["key", "ts", "id"]).reset_index(drop=True)
    gap = pdf.groupby("key")["ts"].diff().dt.days
    new = (gap > 6) | gap.isna()
    new |= (pdf["outcome"] == "tow").shift(fill_value=False)
    pdf["new"] = new
    number = pdf.groupby("key")["new"].cumsum()
    return {
        int(i): None if k is None or pd.isna(k) else f"{k}_{int(n)}" for i, k, n in zip(pdf["id"], pdf["key"], number)
    }


@pytest.mark.parametrize("limit", [10**6, 25])
def test_cases_equal_pandas(spark, limit):
    df = _calls(spark, 900, seed=3)
    out = assign_cases(df, "key", "ts", 6, F.col("outcome") == "tow", "case_id", tie=["id"], max_group_rows=limit)
    got = {r["id"]: r["case_id"] for r in out.collect()}
    want = _pandas_cases(df)
    assert len(got) == 900
    assert got == want


def test_case_boundaries(spark):
    def at(days, hours=0):
        return DAY + dt.timedelta(days=days, hours=hours)

    rows = [
        ("a", at(0), "jump"),
        ("a", at(6), "jump"),  # 6 d: same case
        ("a", at(12, 23), "jump"),  # 6 d 23 h: same case
        ("a", at(19, 23), "tow"),  # 7 d 0 h: new case
        ("a", at(20), "jump"),  # after a tow: new case
        ("b", at(20), "jump"),  # other entity, right after a tow elsewhere
        (None, at(1), "jump"),
    ]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, outcome string")
    out = assign_cases(df, "key", "ts", 6, F.col("outcome") == "tow", "case_id")
    got = [r["case_id"] for r in sorted(out.collect(), key=lambda r: (r["key"] or "z", r["ts"]))]
    assert got == ["a_1", "a_1", "a_1", "a_2", "a_3", "b_1", None]


@pytest.mark.parametrize("limit", [10**6, 2])
def test_stay_rules(spark, limit):
    days = [("s1", 0), ("s1", 30), ("s2", 37), ("s3", 45), (None, 60), (None, 80)]
    rows = [("a", DAY + dt.timedelta(days=d), s, i) for i, (s, d) in enumerate(days)] + [("b", DAY, "s1", 9)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, stay string, id long")
    out = assign_stays(df, "key", "ts", "stay", 7, "stay_id", tie=["id"], max_group_rows=limit)
    got = {r["id"]: r["stay_id"] for r in out.collect()}
    # same number 30 d apart continues, 7 d continues, 8 d starts anew, missing numbers never equal
    assert got == {0: "a_1", 1: "a_1", 2: "a_1", 3: "a_2", 4: "a_3", 5: "a_4", 9: "b_1"}


def test_flag_repeat_counts_any_previous_call(spark):
    rows = [("a", 0, "tow"), ("a", 10, "jump"), ("a", 20, "tow"), ("a", 40, "tow")]
    df = spark.createDataFrame([(k, DAY + dt.timedelta(days=d), o) for k, d, o in rows], "key string, ts timestamp_ntz, o string")
    tow = F.col("o") == "tow"
    any_call = flag_repeat(df, "key", "ts", 14, tow, "again").orderBy("ts").collect()
    assert [r["again"] for r in any_call] == [False, False, True, False]
    last_tow = flag_repeat(df, "key", "ts", 20, tow, "again", among=tow).orderBy("ts").collect()
    assert [r["again"] for r in last_tow] == [False, False, True, True]


def _asof_sides(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.choice("aab"), DAY + dt.timedelta(days=rng.randrange(60))) for i in range(80)]
    right = [(100 + i, rng.choice("aab"), DAY + dt.timedelta(days=rng.randrange(60))) for i in range(60)]
    left += [(90, None, DAY), (91, "a", None)]
    right += [(190, None, DAY), (191, "a", None)]
    return (
        spark.createDataFrame(left, "id long, key string, at timestamp_ntz"),
        spark.createDataFrame(right, "rid long, key string, rat timestamp_ntz"),
        left,
        right,
    )


def _brute_asof(left, right, direction, days):
    out = {}
    for i, key, at in left:
        best = None
        for rid, rkey, rat in right:
            if key is None or at is None or rkey != key or rat is None:
                continue
            gap = (rat - at).days
            if abs(gap) > days or (direction == "forward" and gap < 0) or (direction == "backward" and gap > 0):
                continue
            # forward: first of a tie, backward: last of a tie, nearest: backward wins a tie
            rank = (abs(gap), gap > 0, rid if gap > 0 or direction == "forward" else -rid)
            if best is None or rank < best[0]:
                best = (rank, rid)
        out[i] = best and best[1]
    return out


@pytest.mark.parametrize("direction", ["forward", "backward", "nearest"])
@pytest.mark.parametrize("limit", [10**6, 9])
def test_asof_equals_brute_force(spark, direction, limit):
    left, right, lrows, rrows = _asof_sides(spark, 11)
    out = asof_join(
        left, right, "at", "rat", ["key"], direction, dt.timedelta(days=4), ["rid"], max_group_rows=limit
    )
    got = {r["id"]: r["rid"] for r in out.collect()}
    assert got == _brute_asof(lrows, rrows, direction, 4)


def test_asof_equals_pandas(spark):
    left, right, lrows, rrows = _asof_sides(spark, 5)
    lp = pd.DataFrame([r for r in lrows if r[1] and r[2]], columns=["id", "key", "at"]).sort_values("at", kind="stable")
    rp = pd.DataFrame([r for r in rrows if r[1] and r[2]], columns=["rid", "key", "rat"]).sort_values(["rat", "rid"])
    want = pd.merge_asof(
        lp, rp, left_on="at", right_on="rat", by="key", direction="forward", tolerance=pd.Timedelta(days=3)
    )
    out = asof_join(left, right, "at", "rat", ["key"], "forward", dt.timedelta(days=3), ["rid"])
    got = {r["id"]: r["rid"] for r in out.collect() if r["id"] < 90}
    assert got == {int(i): None if pd.isna(r) else int(r) for i, r in zip(want["id"], want["rid"])}


def test_asof_tolerance_is_inclusive_to_the_second(spark):
    left = spark.createDataFrame([(1, "a", DAY), (2, "b", DAY)], "id long, key string, at timestamp_ntz")
    right = spark.createDataFrame(
        [("a", DAY + dt.timedelta(days=7)), ("b", DAY + dt.timedelta(days=7, seconds=1))], "key string, rat timestamp_ntz"
    )
    out = asof_join(left, right, "at", "rat", ["key"], tolerance=dt.timedelta(days=7)).orderBy("id").collect()
    assert [r["rat"] is not None for r in out] == [True, False]


def test_sweep_equals_single_joins(spark):
    left, right, lrows, rrows = _asof_sides(spark, 21)
    sweep = {r["tolerance_days"]: r["matches"] for r in asof_sweep(left, right, "at", "rat", ["key"], range(0, 10), ["rid"]).collect()}
    for days in range(0, 10):
        assert sweep[days] == sum(v is not None for v in _brute_asof(lrows, rrows, "forward", days).values())
    assert list(sweep.values()) == sorted(sweep.values())


@pytest.mark.parametrize("limit", [10**6, 20])
def test_quantiles_equal_numpy(spark, limit):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([None, rng.random() * 100, float(rng.randrange(5))])) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = df.toPandas().dropna()
    ps = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    whole = quantiles(df, "v", ps, max_group_rows=limit).first()
    assert list(whole) == pytest.approx([pdf["v"].quantile(p) for p in ps])
    for row in quantiles(df, "v", ps, by=["g"], max_group_rows=limit).collect():
        values = pdf[pdf["g"] == row["g"]]["v"]
        assert list(row)[1:] == pytest.approx([values.quantile(p) for p in ps])


def test_quantile_fixture(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 3, 7)], "v int")
    assert list(quantiles(df, "v", (0.8, 0.9)).first()) == pytest.approx([3.8, 5.4])


@pytest.mark.parametrize("limit", [10**6, 3])
def test_box_stats(spark, limit):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 5, 6, 7, 100)], "g string, v int")
    row = box_stats(df, "v", ["g"], max_group_rows=limit).first()
    assert (row["q1"], row["median"], row["q3"], row["whisker_low"], row["whisker_high"]) == (2.75, 4.5, 6.25, 1, 7)
