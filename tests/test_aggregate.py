import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from caseloom.functions import special
from caseloom.operators import aggregate as A
from caseloom.operators import stats as S
from caseloom.operators.quantiles import flag_top_quantile, quantiles, remove_outliers


def _cells(rows, spark):
    return spark.createDataFrame(rows, "a string, b string")


def test_null_keys_are_dropped(spark):
    df = _cells([("x", "1"), ("x", "1"), ("y", None), (None, "1")], spark)
    assert sorted(map(tuple, A.value_counts(df, "a").collect())) == [("x", 2), ("y", 1)]
    assert A.value_counts(df, ["a", "b"]).count() == 1
    shares = {r["a"]: r["share"] for r in A.value_counts(df, "a", normalize=True).collect()}
    assert shares == pytest.approx({"x": 2 / 3, "y": 1 / 3})


def test_crosstab_has_zero_cells(spark):
    df = _cells([("x", "1"), ("x", "2"), ("y", "1")], spark)
    got = {(r["a"], r["b"]): (r["n"], r["row_total"]) for r in A.crosstab(df, "a", "b").collect()}
    assert got == {("x", "1"): (1, 2), ("x", "2"): (1, 2), ("y", "1"): (1, 1), ("y", "2"): (0, 1)}
    assert A.ordered_crosstab(df, "a", "b").first()["a"] == "x"


def test_crosstab_takes_any_number_of_levels(spark):
    many = A.MAX_LEVELS + 5
    df = spark.range(many).select((F.col("id") % 2).alias("a"), F.col("id").cast("string").alias("b"))
    grid = A.crosstab(df, "a", "b")
    got = grid.groupBy("a").agg(F.count(F.lit(1)), F.sum("n"), F.max("n"), F.first("row_total")).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(0, many, many - many // 2, 1, many - many // 2), (1, many, many // 2, 1, many // 2)]
    assert A.crosstab(df, "a", "b", ["3", "none"]).count() == 2


def test_pivot_of_very_many_levels_is_sparse(spark):
    n = A.MAX_LEVELS + 1
    df = spark.range(n).select((F.col("id") % 2).alias("k"), F.format_string("l%05d", "id").alias("level"))
    found = A.pivot_counts(df, "k", "level", prefix="is_")
    assert found.columns == ["k", "is_counts"]
    assert {(r["k"], r["is_counts"].size, r["is_counts"].numNonzeros()) for r in found.collect()} == {(0, n + 1, n // 2 + 1), (1, n + 1, n // 2)}


def test_levels_are_bounded(spark):
    with pytest.raises(ValueError):
        A.levels(_cells([(str(i), "1") for i in range(5)], spark), "a", limit=4)


def test_two_by_two_uses_yates(spark):
    rows = [("x", "1")] * 10 + [("x", "2")] * 5 + [("y", "1")] * 4 + [("y", "2")] * 11
    summary, cells = S.chi_square(_cells(rows, spark), "a", "b")
    row = summary.first()
    observed = [[10, 5], [4, 11]]
    total, want = 30, 0.0
    for i in range(2):
        for j in range(2):
            e = sum(observed[i]) * (observed[0][j] + observed[1][j]) / total
            want += (abs(observed[i][j] - e) - 0.5) ** 2 / e
    assert row["dof"] == 1
    assert row["statistic"] == pytest.approx(want)
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(want / 2)))
    assert cells.agg(F.sum("residual")).first()[0] == pytest.approx(0.0, abs=1e-9)


def test_chi_square_uncorrected_above_one_degree(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xyz"), rng.choice("123")) for _ in range(200)]
    row = S.chi_square(_cells(rows, spark), "a", "b")[0].first()
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    df = _cells(rows, spark)
    df = StringIndexer(inputCols=["a", "b"], outputCols=["ai", "bi"]).fit(df).transform(df)
    df = VectorAssembler(inputCols=["ai"], outputCol="f").transform(df)
    check = ChiSquareTest.test(df, "f", "bi").first()
    assert row["dof"] == check["degreesOfFreedom"][0]
    assert row["statistic"] == pytest.approx(check["statistics"][0])
    assert row["p_value"] == pytest.approx(check["pValues"][0])


def test_tails_against_closed_forms():
    for x in (0.1, 1.0, 4.8214, 30.0):
        assert special.chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        assert special.chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)
    for t in (0.2, 1.0, 3.0):
        assert special.t_tail(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-10)
        assert special.t_tail(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)
        assert special.f_tail(t * t, 1, 7) == pytest.approx(special.t_tail(t, 7), rel=1e-10)
    assert special.t_reach(10) == pytest.approx(2.2281388519649385)


def test_ols_on_known_line(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0]
    ys = [2.1, 3.9, 6.2, 7.8, 10.1]
    summary, predicted = S.ols(spark.createDataFrame(list(zip(xs, ys)), "x double, y double"), "x", "y")
    row = summary.first()
    assert row["slope"] == pytest.approx(1.99)
    assert row["intercept"] == pytest.approx(0.05)
    rss = sum((y - 0.05 - 1.99 * x) ** 2 for x, y in zip(xs, ys))
    assert row["slope_se"] == pytest.approx(math.sqrt(rss / 3 / 10))
    assert row["intercept_se"] == pytest.approx(math.sqrt(rss / 3 * (1 / 5 + 9 / 10)))
    assert row["f_statistic"] == pytest.approx(row["slope_t"] ** 2)
    assert row["f_p"] == pytest.approx(row["slope_p"])
    assert row["slope_high"] - row["slope"] == pytest.approx(3.182446305284263 * row["slope_se"])
    assert row["aic"] == pytest.approx(5 * (math.log(2 * math.pi * rss / 5) + 1) + 4)
    assert [r["predicted"] for r in predicted.orderBy("x").collect()] == pytest.approx([0.05 + 1.99 * x for x in xs])


def test_ols_matches_spark_regression(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = random.Random(8)
    df = spark.createDataFrame([(x, 3 * x + rng.gauss(0, 5)) for x in map(float, range(60))], "x double, y double")
    row = S.ols(df, "x", "y")[0].first()
    fitted = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(
        VectorAssembler(inputCols=["x"], outputCol="f").transform(df)
    )
    info = fitted.summary
    assert [row["slope_se"], row["intercept_se"]] == pytest.approx(list(info.coefficientStandardErrors))
    assert [row["slope_t"], row["intercept_t"]] == pytest.approx(list(info.tValues))
    assert [row["slope_p"], row["intercept_p"]] == pytest.approx(list(info.pValues), abs=1e-12)


def test_policy_edge_floors_days(spark):
    day = dt.datetime(2021, 1, 10)
    rows = [
        (day, dt.date(2021, 1, 1), dt.date(2021, 1, 11)),
        (day + dt.timedelta(hours=6), dt.date(2021, 1, 1), dt.date(2021, 1, 11)),  # 18 h left: day 0, out
        (day, dt.date(2021, 1, 20), dt.date(2021, 2, 9)),  # starts later: no start offset
        (day, dt.date(2010, 1, 1), dt.date(2021, 1, 12)),  # too long since the start
        (day, None, dt.date(2021, 1, 12)),
    ]
    df = spark.createDataFrame(rows, "at timestamp_ntz, s date, e date")
    got = sorted(map(tuple, S.policy_edge(df, "at", "s", "e").collect()))
    assert got == [("since_start", 9, 1), ("until_end", 1, 1), ("until_end", 2, 1), ("until_end", 30, 1)]


def test_corr_matrix_is_listwise_and_symmetric(spark):
    rows = [(True, True, False), (False, False, False), (True, False, False), (None, True, False), (True, True, False)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    got = {(r[0], r[1]): r[2] for r in S.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9
    assert got["a", "a"] == pytest.approx(1.0)
    assert got["a", "b"] == got["b", "a"] == pytest.approx(1 / math.sqrt(3))
    assert got["a", "c"] is None and got["c", "c"] is None


def test_histogram_steps_are_round(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 3, 7, 12, 50, 93, 100)], "v double")
    got = [(r["bin_start"], r["bin_end"], r["n"]) for r in A.histogram(df, "v", maxbins=10).orderBy("bin_start").collect()]
    assert got == [(0, 10, 3), (10, 20, 1), (50, 60, 1), (90, 100, 2)]
    steps = A.histogram(df, "v", step=30).orderBy("bin_start").collect()
    assert [(r["bin_start"], r["n"]) for r in steps] == [(0, 4), (30, 1), (90, 2)]
    one = A.histogram(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v", maxbins=10).collect()
    assert sum(r["n"] for r in one) == 2


def test_summary_and_normal_curve(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 7)], "v double")
    got = {r["statistic"]: r["value"] for r in S.summary_stats(df, "v").collect()}
    assert got == pytest.approx({"Mean": 3.0, "Median": 2.0, "Q0.1": 1.4, "Q0.9": 5.4})
    curve = S.normal_curve(df, "v").orderBy("x").collect()
    assert len(curve) == 100 and (curve[0]["x"], curve[-1]["x"]) == (1.0, 7.0)
    sd = 2.345208
    assert curve[0]["density"] == pytest.approx(math.exp(-((1 - 3) / sd) ** 2 / 2) / sd / math.sqrt(2 * math.pi), rel=1e-5)


def test_top_quantile_and_outliers(spark):
    rows = [("a", "tow")] * 5 + [("b", "tow")] + [("c", "jump")] * 9 + [(None, "tow")] * 20
    df = spark.createDataFrame(rows, "k string, o string")
    tows = flag_top_quantile(df, "k", F.count(F.lit(1)), 0.75, "top", among=F.col("o") == "tow")
    assert {r["k"]: r["top"] for r in tows.distinct().collect()} == {"a": True, "b": False, "c": False, None: False}
    strict = flag_top_quantile(df, "k", F.count(F.lit(1)), 1.0, "top", strict=True)
    assert not any(r["top"] for r in strict.collect())
    values = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 100)] + [(None,)], "v double")
    assert sorted(r["v"] for r in remove_outliers(values, "v").collect()) == [1, 2, 3, 4, 5]


def test_words(spark):
    df = spark.createDataFrame([("Die Tür klemmt, die TÜR! 12",), ("2x tür_a klemmt",), (None,)], "t string")
    stop = spark.createDataFrame([("DIE",)], "stopwords string")
    got = [tuple(r) for r in A.top_words(df, "t", 3, stop).collect()]
    assert got == [("klemmt", 2), ("tür", 2), ("2x", 1)]


def test_profiles(spark):
    rows = [("g", 1, 10.0, "x"), ("g", 3, None, "x"), ("h", 5, 2.0, "y"), ("g", 8, 30.0, None)]
    df = spark.createDataFrame(rows, "g string, a int, b double, c string")
    got = {(r["feature"], r["g"], r["kind"]): r["value"] for r in A.profile_groups(df, "g", ["a", "b"]).collect()}
    assert got == {
        ("a", "g", "Mean"): 4.0, ("a", "g", "Median"): 3.0, ("b", "g", "Mean"): 20.0, ("b", "g", "Median"): 20.0,
        ("a", "h", "Mean"): 5.0, ("a", "h", "Median"): 5.0, ("b", "h", "Mean"): 2.0, ("b", "h", "Median"): 2.0,
    }
    shares = {(r["g"], r["level"]): r["share"] for r in A.profile_nominal(df, "g", ["c"]).collect()}
    assert shares == {("g", "x"): 1.0, ("h", "y"): 1.0}
    sums = {(r["g"], r["feature"]): r["total"] for r in A.melt_sum(df.fillna(0), ["g"], ["a", "b"]).collect()}
    assert sums == {("g", "a"): 12, ("g", "b"): 40, ("h", "a"): 5, ("h", "b"): 2}


def test_joint_counts_stand_for_the_rows(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["1", "2", "3", None]), rng.choice("pq")) for _ in range(150)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    joint = A.joint_counts(df, ["a", "b", "c"])
    assert joint.agg(F.sum("n")).first()[0] == 150
    for direct, weighted in [
        (A.value_counts(df, "a", normalize=True), A.value_counts(joint, "a", normalize=True, weight="n")),
        (A.crosstab(df, "a", "b"), A.crosstab(joint, "a", "b", weight="n")),
        (S.chi_square(df, "a", "b")[0], S.chi_square(joint, "a", "b", weight="n")[0]),
    ]:
        assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, weighted.collect()))


def test_quantiles_do_not_depend_on_the_path(spark):
    dice = random.Random(12)
    rows = [(g, round(dice.uniform(0, 10**6), 2)) for g in ("a", "b") for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, x double")
    ps = [0.0, 0.1, 0.25, 0.333, 0.5, 0.77, 0.9, 1.0]
    for by in ([], ["g"]):
        one, many = (sorted(map(tuple, quantiles(df, "x", ps, by, max_group_rows=m).collect())) for m in (10**6, 100))
        assert one == many
