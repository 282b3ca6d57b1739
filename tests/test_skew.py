"""A third of all rows in one key: groups are sliced, joins are split, nothing is lost."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators.intervals import point_in_interval
from caseloom.operators.joins import flag_exists
from caseloom.operators.ordered import SLICE, OrderedGroups
from caseloom.operators.quantiles import flag_top_quantile
from caseloom.operators.sessions import assign_cases
from caseloom.operators import ordered
from caseloom.operators.skew import spread_join
from caseloom.plans import cases
from caseloom.plans.names import Calls, Repairs

ROWS = 60_000


@pytest.fixture(scope="module")
def skewed(spark):
    hot = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    key = F.when(hot, "hot").otherwise(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(500))))
    ts = F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.hash("id"), F.lit(50_000_000))).cast("timestamp_ntz")
    return spark.range(ROWS).select("id", key.alias("k"), ts.alias("ts"), (F.col("id") % 9 == 0).alias("tow")).cache()


def test_no_slice_is_large(skewed):
    limit = 1000
    scan = OrderedGroups(skewed, ["k"], ["ts", "id"], max_group_rows=limit)
    sizes = [r["count"] for r in scan.df.groupBy("k", SLICE).count().collect()]
    assert max(sizes) <= 2 * limit and sum(sizes) == ROWS


def test_one_moment_for_all_rows_is_sliced_by_the_tie(skewed):
    flat = skewed.withColumn("ts", F.lit("2021-01-01").cast("timestamp_ntz"))
    scan = OrderedGroups(flat, ["k"], ["ts", "id"], max_group_rows=1000).running_sum("n", F.lit(1))
    assert max(r["count"] for r in scan.df.groupBy("k", SLICE).count().collect()) <= 2000
    hot = scan.result().filter("k = 'hot'")
    assert hot.agg(F.max("n")).first()[0] == hot.count() == hot.select("n").distinct().count()


def test_hot_missing_key_is_spread(skewed):
    holes = skewed.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    scan = OrderedGroups(holes, ["k"], ["ts", "id"], max_group_rows=1000).previous(before="ts").running_sum("n", F.lit(1))
    assert max(r["count"] for r in scan.df.groupBy("k", SLICE).count().collect()) < 1000
    nulls = scan.result().filter("k IS NULL")
    assert nulls.count() == skewed.filter("k = 'hot'").count()
    assert nulls.filter("before IS NOT NULL OR n IS NOT NULL").count() == 0


def test_cases_do_not_depend_on_slices(skewed):
    def cases(limit):
        out = assign_cases(skewed, "k", "ts", 0, F.col("tow"), "case_id", ["id"], max_group_rows=limit)
        return out.agg(F.count_distinct("case_id"), F.sum(F.xxhash64("id", "case_id").cast("decimal(38,0)"))).first()

    assert cases(10**9) == cases(900)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, skewed, how):
    holes = skewed.withColumn("k", F.when(F.col("id") % 5 != 0, F.col("k")))
    right = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k <> 'k1'")
    plain = holes.join(right, ["k"], how).select(*holes.columns, *(["n"] if how in ("left", "inner") else []))
    spread = spread_join(holes, right, ["k"], how, max_group_rows=700)
    assert spread.columns == plain.columns
    assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0


def test_spread_join_leaves_no_large_task(spark, skewed):
    right = skewed.select("k").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")

        def largest(joined):
            return joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        assert largest(skewed.join(right, "k")) > ROWS / 3
        # Rows that differ in nothing are spread too.
        assert largest(spread_join(skewed.select("k"), right, ["k"], "inner", max_group_rows=500)) < ROWS / 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_flags_come_back_to_hot_keys(skewed):
    rows = F.count(F.lit(1))
    top = flag_top_quantile(skewed, "k", rows, 0.99, "top", max_group_rows=1000)
    plain = flag_top_quantile(skewed, "k", rows, 0.99, "top")
    assert top.exceptAll(plain).count() == 0 and top.count() == ROWS
    assert top.filter("top AND k = 'hot'").count() == skewed.filter("k = 'hot'").count()
    known = flag_exists(skewed, skewed.filter("k = 'hot'"), "k", "known", max_group_rows=1000)
    assert known.filter("known").count() == skewed.filter("k = 'hot'").count()


def test_points_meet_no_pairs(spark, skewed):
    """A hot key with long overlapping intervals: joined rows stay within a few per point."""
    points = skewed.filter("k = 'hot'").select("id", "k", "ts")
    spans = points.select("k", F.to_date("ts").alias("s"), F.date_add(F.to_date("ts"), 400).alias("e"))
    out = point_in_interval(points, spans, "k", "ts", "s", "e", max_group_rows=20)
    first = points.agg(F.min(F.to_date("ts"))).first()[0]
    got = out.agg(F.count("*"), F.count_if("inside"), F.min("s"), F.max("e")).first()
    assert got[0] == points.count()
    assert got[1] > 0.99 * got[0]
    assert got[2] == first


def test_entity_hot_by_its_stays_only_is_sliced(spark, monkeypatch):
    calls = Calls(entity="k", case_number="id", at="ts", outcome="outcome", tows=("tow",), tie=("id",), case_id="case_id")
    repairs = Repairs(entity="car", line="line", start="start", tie=("line",), stay_id="stay_id")
    day = F.date_add(F.lit("2021-01-01").cast("date"), (F.col("id") % 700).cast("int"))
    few = spark.range(400).select(
        "id", F.concat(F.lit("k"), F.col("id") % 40).alias("k"), day.cast("timestamp_ntz").alias("ts"), F.lit("tow").alias("outcome")
    ).withColumn("case_id", F.concat_ws("_", "k", "id"))
    car = F.when(F.col("id") % 3 > 0, "k1").otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    stays = spark.range(6000).select(car.alias("car"), F.col("id").alias("line"), day.alias("start"), F.col("id").cast("string").alias("stay_id"))
    seen, hot_keys = [], ordered.hot_keys

    def watched(*args):
        seen.append(hot_keys(*args))
        return seen[-1]

    monkeypatch.setattr(ordered, "hot_keys", watched)
    split = cases.link_cases(few, stays, calls, repairs, max_group_rows=500)
    assert [[r["k"] for r in hot.collect()] if hot is not None else None for hot, _ in seen] == [None, ["k1"]]
    whole = cases.link_cases(few, stays, calls, repairs)
    assert split.exceptAll(whole).count() == 0 and whole.exceptAll(split).count() == 0
    assert whole.filter("stay_id IS NOT NULL AND k = 'k1'").count() > 0
