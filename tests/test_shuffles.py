"""What is shuffled: each row about once per step, and costly steps are not run again to learn sizes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseloom.operators.intervals import point_in_interval
from caseloom.operators.skew import Sizes, hot_keys
from caseloom.plans import cases as C
from caseloom.session import joined_where_dealt
from catalog import caseload
from catalog.tables import REPAIRS, orders_are_small, repair_lines, repair_sizes

SMALL = "/root/testdata/sf0.001"


def shuffled_records(df):
    """Rows that all exchanges of the executed plan wrote."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = 0
        if name == "ShuffleExchangeExec":
            own = node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def spans(spark):
    day = F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") * 37 % 700).cast("int"))
    return spark.range(4000).select((F.col("id") % 200).alias("k"), day.alias("s"), F.date_add(day, 61).alias("e"))


def test_intervals_are_shuffled_not_their_cells(spark, spans):
    points = spark.range(400).select((F.col("id") % 200).alias("k"), F.timestamp_seconds(1577836800 + F.col("id") * 100_000).cast("timestamp_ntz").alias("at"))
    found = point_in_interval(points, spans, "k", "at", "s", "e")
    # Once per start day, once per piece, and the points.
    assert shuffled_records(found) < 4 * spans.count() + 8 * points.count()


def test_a_hot_key_of_intervals_is_aggregated_before_the_shuffle(spark):
    spans = spark.range(20_000).select(
        F.lit(1).alias("k"), F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 5).cast("int")).alias("s")
    ).withColumn("e", F.date_add("s", 400))
    points = spark.createDataFrame([(1, dt.datetime(2020, 7, 1))], "k int, at timestamp_ntz")
    found = point_in_interval(points, spans, "k", "at", "s", "e")
    assert shuffled_records(found) < 1000
    assert [(r["s"], r["e"], r["inside"]) for r in found.collect()] == [(dt.date(2020, 1, 1), dt.date(2021, 2, 8), True)]


@pytest.mark.parametrize("start", [dt.date(2019, 12, 25), dt.date(1960, 3, 1)])
def test_pieces_of_long_and_nested_intervals(spark, start):
    days = [(0, 900), (0, 3), (100, 101), (100, 700), (127, 130), (128, 256), (300, 302), (899, 2000)]
    spans = [(1, start + dt.timedelta(a), start + dt.timedelta(b)) for a, b in days]
    moments = [dt.datetime.combine(start, dt.time()) + dt.timedelta(hours=12 * i) for i in range(0, 4100, 7)]
    found = point_in_interval(
        spark.createDataFrame([(1, m) for m in moments], "k int, at timestamp_ntz"),
        spark.createDataFrame(spans, "k int, s date, e date"),
        "k", "at", "s", "e",
    )
    day, midnight = dt.timedelta(1), lambda d: dt.datetime.combine(d, dt.time())
    for row in found.collect():
        hits = [(s, e) for _, s, e in spans if midnight(s) + day < row["at"] < midnight(e)]
        wanted = (min(hits)[0], max(hits)[1], True) if hits else (None, None, False)
        assert (row["s"], row["e"], row["inside"]) == wanted, row


def test_sizes_come_from_a_sample_drawn_before_the_costly_steps(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    shares = []

    def sample(share):
        shares.append(share)
        return rows.sample(share, seed=17)

    found, limit = hot_keys(Sizes(rows, sample), ["k"], 5_000)
    assert limit == 5_000 and shares == [0.2]
    assert [r["k"] for r in found.collect()] == [7]


def test_ends_of_repairs_need_no_join(spark):
    lines, ends = repair_lines(spark, SMALL)
    assert "Join" in plan_of(lines) and "Join" not in plan_of(ends)
    assert ends.join(lines, "line_id").count() == lines.count()


def test_stays_are_made_once(spark, monkeypatch):
    assert "Join" in plan_of(repair_sizes(spark, SMALL).sample(0.5))
    for linked in (caseload._linked(spark, SMALL), caseload._links(spark, SMALL)[1]):
        assert "l_quantity" not in plan_of(linked)


def test_lines_dealt_by_order_meet_their_ends_there(spark):
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        stays = caseload._stays(spark, SMALL)
        # By customer and by order; nothing by id. For links, lines and ends are dealt once for both.
        with joined_where_dealt(spark):
            assert shuffled_records(stays) <= 3 * n + orders
            assert shuffled_records(stays.select(*caseload.LINK_COLUMNS)) <= 2 * n + orders
    finally:
        spark.conf.set(limit, before)
    plain = C.build_stays(*repair_lines(spark, SMALL), REPAIRS, opens=caseload.OPENS)
    assert sorted(stays.select(*plain.columns).collect()) == sorted(plain.collect())


def test_lines_of_a_huge_order_are_not_dealt_by_it(spark, tmp_path):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    lines.withColumn("l_orderkey", F.when(F.col("l_linenumber") < 4, 1).otherwise(F.col("l_orderkey")).cast("bigint")).write.parquet(
        f"{tmp_path}/lineitem.parquet"
    )
    assert orders_are_small(spark, SMALL, 1000) and not orders_are_small(spark, str(tmp_path), 1000)
