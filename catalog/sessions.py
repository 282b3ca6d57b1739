"""Previous rows, running totals, cases and stays."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import sessions as W
from catalog.registry import query, unless
from catalog.tables import CASES_SQL, STAYS_SQL, repair_lines, table


@query(
    """
    SELECT event_id, CAST(floor(epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 86400000000) AS BIGINT)
           AS days_since_prev
    FROM events
    """
)
def days_since_prev(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return W.days_since_prev(events, "user_id", "ts", ["event_id"]).select("event_id", "days_since_prev")


@query(
    """
    SELECT event_id, coalesce(k = lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS same_as_prev
    FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_type END AS k FROM events)
    """
)
def same_as_prev(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", unless(F.col("event_id") % 7 == 0, "event_type").alias("k"))
    return W.same_as_prev(events, "user_id", ["ts", "event_id"], "k").select("event_id", "same_as_prev")


@query(
    """
    SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors
    FROM events
    """
)
def running_sum(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    counted = W.running_sum(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", "errors")
    return counted.select("event_id", "errors")


@query("WITH" + CASES_SQL + "SELECT o_orderkey, case_no, case_id FROM cases")
def assign_cases(spark, folder):
    """Orders grouped into cases: more than 90 days or a finished order start a new one."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    cases = W.assign_cases(
        orders, "o_custkey", "o_orderdate", 90, F.col("o_orderstatus") == "F", "case_id", ["o_orderkey"], "case_no"
    )
    return cases.select("o_orderkey", "case_no", "case_id")


@query("WITH" + STAYS_SQL + "SELECT line_id, stay_id FROM stays")
def assign_stays(spark, folder):
    """Shipments grouped into stays: the same order or at most seven days continue one."""
    lines, _ = repair_lines(spark, folder)
    return W.assign_stays(lines, "o_custkey", "l_shipdate", "l_orderkey", 7, "stay_id", ["line_id"]).select("line_id", "stay_id")


@query(
    """
    SELECT event_id, gap AS days, coalesce(gap <= 0 AND event_type = 'error', false) AS again,
           coalesce(error_gap <= 2 AND event_type = 'error', false) AS error_again
    FROM (
      SELECT *, CAST(floor(epoch_us(ts - lag(ts) OVER w) / 86400000000) AS BIGINT) AS gap,
             CAST(floor(epoch_us(ts - max(CASE WHEN event_type = 'error' THEN ts END) OVER (
               PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 86400000000) AS BIGINT) AS error_gap
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    """
)
def flag_repeat(spark, folder):
    """Errors soon after the user's previous event, and soon after the previous error."""
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    error = F.col("event_type") == "error"
    flagged = W.flag_repeat(events, "user_id", "ts", 0, error, "again", ["event_id"], gap_col="days")
    flagged = W.flag_repeat(flagged, "user_id", "ts", 2, error, "error_again", ["event_id"], among=error)
    return flagged.select("event_id", "days", "again", "error_again")
