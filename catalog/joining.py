"""Equi joins, nearest matches in time, points in intervals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caseloom.operators import asof, joins
from caseloom.operators.intervals import point_in_interval
from caseloom.operators.rows import reorder
from catalog.registry import query, unless
from catalog.tables import REPAIRS_SQL, repair_lines, repairs, table


@query(
    """
    SELECT c_custkey, n_name, r_name FROM customer
    LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 7 <> 0
    LEFT JOIN region ON r_regionkey = n_regionkey
    """
)
def enrich_left(spark, folder):
    """Customers with nation and region; some nations are unknown."""
    customers = table(spark, folder, "customer").select("c_custkey", unless(F.col("c_custkey") % 7 == 0, "c_nationkey").alias("n_nationkey"))
    nations = table(spark, folder, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    joined = customers.join(nations, "n_nationkey", "left").join(table(spark, folder, "region"), "r_regionkey", "left")
    return reorder(joined.select("n_name", "r_name", "c_custkey"), ["c_custkey"])


@query(
    "WITH"
    + REPAIRS_SQL
    + """
    SELECT line_id, o_custkey, l_shipdate, l_enddate, CAST(l_enddate - l_shipdate AS INTEGER) AS days FROM repairs
    """
)
def inner_ends(spark, folder):
    """Repair lines with their end."""
    lines, ends = repair_lines(spark, folder)
    joined = lines.join(ends, "line_id").withColumn("days", F.datediff("l_enddate", "l_shipdate"))
    return joined.drop("l_orderkey")


@query(
    """
    WITH dim AS (SELECT s_suppkey, n_regionkey, s_nationkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    coarse AS (SELECT DISTINCT n_regionkey, s_nationkey FROM dim),
    c AS (SELECT c_custkey, c_custkey AS code, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 5 AS INTEGER) END AS line FROM customer)
    SELECT c_custkey, s_suppkey AS code, line, s_suppkey, n_regionkey, s_nationkey, s_name FROM c JOIN dim ON s_suppkey = code
    UNION ALL
    SELECT c_custkey, NULL, line, NULL, n_regionkey, s_nationkey, NULL
    FROM c LEFT JOIN coarse ON n_regionkey = line WHERE code NOT IN (SELECT s_suppkey FROM dim)
    """
)
def fallback_join(spark, folder):
    """By the exact key where known, else by a coarser one that gives several rows."""
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_custkey").alias("code"),
        unless(F.col("c_custkey") % 11 == 0, (F.col("c_custkey") % 5).cast("int")).alias("line"),
    )
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    dim = table(spark, folder, "supplier").join(nations, "s_nationkey").select("s_suppkey", "n_regionkey", "s_nationkey", "s_name")
    return joins.fallback_join(customers, dim, "code", "s_suppkey", "line", "n_regionkey", ["n_regionkey", "s_nationkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def semi(spark, folder):
    """Customers with a costly order."""
    costly = table(spark, folder, "orders").filter("o_totalprice > 450000")
    return joins.semi(table(spark, folder, "customer").select("c_custkey", "c_name"), costly, "c_custkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def anti(spark, folder):
    """Customers without a costly order."""
    costly = table(spark, folder, "orders").filter("o_totalprice > 450000")
    return joins.anti(table(spark, folder, "customer").select("c_custkey", "c_name"), costly, "c_custkey", "o_custkey")


@query(
    """
    SELECT o_orderkey, coalesce(o_custkey % 7 <> 0 AND o_custkey IN
           (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), false) AS builds FROM orders
    """
)
def flag_exists(spark, folder):
    """Orders flagged by whether their customer builds; some customers are unknown."""
    orders = table(spark, folder, "orders").select("o_orderkey", unless(F.col("o_custkey") % 7 == 0, "o_custkey").alias("o_custkey"))
    builders = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'")
    return joins.flag_exists(orders, builders, "o_custkey", "builds", "c_custkey").drop("o_custkey")


@query(
    """
    SELECT c_custkey, coalesce(n, 0) AS orders FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey
    """
)
def lookup_default(spark, folder):
    """Finished orders per customer, zero where there are none."""
    counts = table(spark, folder, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return joins.lookup(table(spark, folder, "customer").select("c_custkey"), counts, "c_custkey", "n", 0, "o_custkey", "orders")


def _orders_and_lines(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines, _ = repair_lines(spark, folder)
    return orders, lines.select("o_custkey", "l_shipdate", "line_id")


FIRST_LINES = """
first_lines AS (SELECT o_custkey, CAST(l_shipdate AS TIMESTAMP) AS l_shipdate, min(line_id) AS line_id FROM repairs GROUP BY ALL)"""


@query(
    "WITH"
    + REPAIRS_SQL
    + ","
    + FIRST_LINES
    + """
    SELECT o.o_orderkey, o.o_custkey,
           CASE WHEN l.l_shipdate <= o.o_orderdate + INTERVAL 7 DAY THEN CAST(l.l_shipdate AS DATE) END AS l_shipdate,
           CASE WHEN l.l_shipdate <= o.o_orderdate + INTERVAL 7 DAY THEN l.line_id END AS line_id
    FROM orders o ASOF LEFT JOIN first_lines l ON o.o_custkey = l.o_custkey AND o.o_orderdate <= l.l_shipdate
    """
)
def asof_forward(spark, folder):
    """Orders with the customer's next shipment within seven days."""
    orders, lines = _orders_and_lines(spark, folder)
    matched = asof.asof_join(
        orders, lines, "o_orderdate", "l_shipdate", ["o_custkey"], tolerance=dt.timedelta(days=7), right_order=["line_id"]
    )
    return matched.drop("o_orderdate")


@query(
    """
    SELECT e.event_id, e.user_id, CASE WHEN p.ts <= e.ts + INTERVAL 12 HOUR THEN p.event_id END AS bought_id
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts <= p.ts
    """
)
def asof_next_purchase(spark, folder):
    """Errors with the user's next purchase in the twelve hours after."""
    errors, bought = _errors_and_purchases(spark, folder)
    matched = asof.asof_join(
        errors, bought, "ts", "bought_at", ["user_id"], tolerance=dt.timedelta(hours=12), right_order=["bought_id"]
    )
    return matched.select("event_id", "user_id", "bought_id")


def _errors_and_purchases(spark, folder):
    events = table(spark, folder, "events")
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = events.filter("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("bought_id"), F.col("value").alias("spent")
    )
    return errors, bought


@query(
    """
    SELECT e.event_id, e.user_id, CASE WHEN p.ts >= e.ts - INTERVAL 12 HOUR THEN p.event_id END AS bought_id,
           CASE WHEN p.ts >= e.ts - INTERVAL 12 HOUR THEN p.value END AS spent
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts
    """
)
def asof_backward(spark, folder):
    """Errors with the user's last purchase in the twelve hours before."""
    errors, bought = _errors_and_purchases(spark, folder)
    matched = asof.asof_join(
        errors, bought, "ts", "bought_at", ["user_id"], "backward", dt.timedelta(hours=12), ["bought_id"]
    )
    return matched.drop("ts", "bought_at")


@query(
    """
    WITH e AS (SELECT * FROM events WHERE event_type = 'error'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
    b AS (SELECT e.event_id, e.user_id, e.ts, p.event_id AS bid, e.ts - p.ts AS bgap
          FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts),
    f AS (SELECT e.event_id, p.event_id AS fid, p.ts - e.ts AS fgap
          FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts <= p.ts),
    both_ways AS (SELECT event_id, user_id, CASE WHEN bgap <= INTERVAL 12 HOUR THEN bid END AS bid, bgap,
                         CASE WHEN fgap <= INTERVAL 12 HOUR THEN fid END AS fid, fgap FROM b JOIN f USING (event_id))
    SELECT event_id, user_id, CASE WHEN bid IS NULL THEN fid WHEN fid IS NULL THEN bid WHEN bgap <= fgap THEN bid ELSE fid END AS bought_id
    FROM both_ways
    """
)
def asof_nearest(spark, folder):
    """Errors with the user's purchase nearest in time, up to twelve hours away."""
    errors, bought = _errors_and_purchases(spark, folder)
    matched = asof.asof_join(
        errors, bought, "ts", "bought_at", ["user_id"], "nearest", dt.timedelta(hours=12), ["bought_id"]
    )
    return matched.select("event_id", "user_id", "bought_id")


@query(
    "WITH"
    + REPAIRS_SQL
    + ","
    + FIRST_LINES
    + """,
    gaps AS (SELECT date_diff('day', o.o_orderdate, l.l_shipdate) AS gap FROM orders o
             ASOF LEFT JOIN first_lines l ON o.o_custkey = l.o_custkey AND o.o_orderdate <= l.l_shipdate)
    SELECT CAST(t AS INTEGER) AS tolerance_days, count(*) FILTER (WHERE gap <= t) AS matches
    FROM gaps, range(1, 31) AS r(t) GROUP BY t
    """
)
def asof_sweep(spark, folder):
    """Orders matched for each tolerance of one to thirty days."""
    orders, lines = _orders_and_lines(spark, folder)
    return asof.asof_sweep(orders, lines, "o_orderdate", "l_shipdate", ["o_custkey"], range(1, 31), ["line_id"])


@query(
    "WITH"
    + REPAIRS_SQL
    + """,
    points AS (SELECT o_orderkey, o_custkey, o_orderdate + to_hours(CAST(o_orderkey % 3 * 7 AS INTEGER)) AS moment FROM orders),
    hits AS (
      SELECT o_orderkey, min(l_shipdate) AS s, max(struct_pack(s := l_shipdate, e := l_enddate)).e AS e
      FROM points JOIN repairs USING (o_custkey) WHERE moment > l_shipdate + INTERVAL 1 DAY AND moment < l_enddate GROUP BY 1)
    SELECT o_orderkey, s AS l_shipdate, e AS l_enddate, s IS NOT NULL AS in_workshop FROM points LEFT JOIN hits USING (o_orderkey)
    """
)
def call_in_workshop(spark, folder):
    """Orders made while one of the customer's repairs was under way."""
    hours = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 3 * 7).cast("int"))
    points = table(spark, folder, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") + hours).alias("at"))
    found = point_in_interval(
        points, repairs(spark, folder), "o_custkey", "at", "l_shipdate", "l_enddate", 1, "in_workshop"
    )
    return found.drop("o_custkey", "at")
