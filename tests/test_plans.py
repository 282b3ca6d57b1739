"""The physical shapes the operators are meant to have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseloom.operators.aggregate import crosstab
from caseloom.operators.asof import asof_join, asof_sweep
from caseloom.operators.dedupe import first_per_key
from caseloom.operators.quantiles import flag_top_quantile
from caseloom.operators.sessions import assign_cases


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "calls")
    ts = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 5000).cast("timestamp_ntz")
    rows = spark.range(2000).select("id", (F.col("id") % 40).alias("k"), ts.alias("ts"), (F.col("id") % 5 == 0).alias("tow"))
    rows.withColumn("unused", F.lit("x")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def plan(capsys):
    def text(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    return text


def test_first_per_key_keeps_one_candidate_before_the_shuffle(calls, plan):
    found = plan(first_per_key(calls, ["k"], ["ts", "id"]))
    assert found.count("WindowGroupLimit") == 2 and found.count("Exchange hashpartitioning") == 1


def test_asof_is_one_shuffle(calls, plan):
    right = calls.filter("tow").select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    joined = plan(asof_join(calls, right, "ts", "rts", ["k"], tolerance=dt.timedelta(days=7), right_order=["rid"]))
    assert joined.count("Exchange hashpartitioning") == 1 and "Join" not in joined
    sweep = plan(asof_sweep(calls, right, "ts", "rts", ["k"], range(1, 31), ["rid"]))
    assert sweep.count("Exchange hashpartitioning") == 1 and "Join" not in sweep


def test_cases_are_one_shuffle_of_the_columns_needed(calls, plan):
    found = plan(assign_cases(calls, "k", "ts", 6, F.col("tow"), "case_id", ["id"]).select("id", "case_id"))
    assert found.count("Exchange hashpartitioning") == 1 and found.count("Sort [") == 1
    assert "unused" not in found


def test_no_pairing_of_tables(calls, plan):
    thresholds = plan(flag_top_quantile(calls, "k", F.count(F.lit(1)), 0.8, "top"))
    grid = plan(crosstab(calls.select(F.col("k").cast("string").alias("a"), F.col("tow").alias("b")), "a", "b"))
    for found in (thresholds, grid):
        assert "Cartesian" not in found and "NestedLoop" not in found


def test_filters_reach_the_scan(calls, plan):
    found = plan(calls.filter((F.col("k") == 3) & F.col("tow")).select("id"))
    assert "EqualTo(k,3)" in found and "unused" not in found
