"""Tests, regression, correlation and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import stats as S
from catalog.registry import query, unless
from catalog.tables import CALLS_SQL, calls, table

CELLS = """
counts AS (SELECT a, b, count(*) AS n FROM data WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
cells AS (
  SELECT a, b, coalesce(n, 0) AS observed,
         sum(coalesce(n, 0)) OVER (PARTITION BY a) * sum(coalesce(n, 0)) OVER (PARTITION BY b) / sum(coalesce(n, 0)) OVER () AS expected
  FROM (SELECT DISTINCT a FROM counts) CROSS JOIN (SELECT DISTINCT b FROM counts) LEFT JOIN counts USING (a, b))"""

ORDER_CLASSES = "data AS (SELECT o_orderstatus AS a, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS b FROM orders),"


def _order_classes(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("a"), unless(F.col("o_orderkey") % 7 == 0, "o_orderpriority").alias("b")
    )


@query(
    "WITH "
    + ORDER_CLASSES
    + CELLS
    + """,
    s AS (SELECT sum((observed - expected) ** 2 / expected) AS x FROM cells)
    SELECT round(x, 6) AS statistic, CAST(8 AS BIGINT) AS dof,
           -- closed form of the tail for eight degrees of freedom
           round(exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6), 6) AS p_value,
           exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6) < 0.05 AS significant
    FROM s
    """
)
def chi_square_summary(spark, folder):
    """Are order status and priority independent?"""
    summary, _ = S.chi_square(_order_classes(spark, folder), "a", "b")
    return summary.withColumns({"statistic": F.round("statistic", 6), "p_value": F.round("p_value", 6)})


@query(
    "WITH "
    + ORDER_CLASSES
    + CELLS
    + """
    SELECT a, b, CAST(observed AS BIGINT) AS observed, round(expected, 6) AS expected, round(observed - expected, 6) AS residual FROM cells
    """
)
def chi_square_cells(spark, folder):
    """Observed, expected and residual counts of status and priority."""
    _, cells = S.chi_square(_order_classes(spark, folder), "a", "b")
    return cells.withColumns({"expected": F.round("expected", 6), "residual": F.round("residual", 6)})


@query(
    "WITH data AS (SELECT l_linestatus AS a, CAST(l_quantity > 40 AS VARCHAR) AS b FROM lineitem),"
    + CELLS
    + """
    SELECT round(sum((abs(observed - expected) - least(0.5, abs(observed - expected))) ** 2 / expected), 6) AS statistic,
           CAST(1 AS BIGINT) AS dof FROM cells
    """
)
def chi_square_two_by_two(spark, folder):
    """One degree of freedom, hence with continuity correction."""
    lines = table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("a"), (F.col("l_quantity") > 40).cast("string").alias("b"))
    summary, _ = S.chi_square(lines, "a", "b")
    return summary.select(F.round("statistic", 6).alias("statistic"), "dof")


@query(
    """
    WITH fit AS (
      SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
             regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx
      FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 7 <> 0)),
    errors AS (SELECT *, sqrt((1 - r2) * syy / (n - 2) / sxx) AS slope_se,
                      sqrt((1 - r2) * syy / (n - 2) * (1 / n + mx * mx / sxx)) AS intercept_se FROM fit)
    SELECT n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(slope_se, 4) AS slope_se,
           round(intercept_se, 4) AS intercept_se, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2,
           round(slope / slope_se, 3) AS slope_t, round(intercept / intercept_se, 3) AS intercept_t,
           round(r2 / (1 - r2) * (n - 2), 2) AS f_statistic, round(ll, 2) AS log_likelihood, round(4 - 2 * ll, 2) AS aic, round(2 * ln(n) - 2 * ll, 2) AS bic
    FROM (SELECT *, -n / 2 * (ln(2 * pi()) + 1 + ln((1 - r2) * syy / n)) AS ll FROM errors)
    """
)
def ols_summary(spark, folder):
    """Line of price on quantity with its standard errors and how well it fits."""
    lines = table(spark, folder, "lineitem").withColumn("l_quantity", unless(F.col("l_orderkey") % 7 == 0, "l_quantity"))
    summary, _ = S.ols(lines, "l_quantity", "l_extendedprice")
    digits = {
        "slope": 4, "intercept": 4, "slope_se": 4, "intercept_se": 4, "r2": 6, "adj_r2": 6, "slope_t": 3,
        "intercept_t": 3, "f_statistic": 2, "log_likelihood": 2, "aic": 2, "bic": 2,
    }
    return summary.select("n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    """
    WITH fit AS (SELECT regr_slope(o_totalprice, x) AS b, regr_intercept(o_totalprice, x) AS a
                 FROM (SELECT *, date_diff('day', DATE '1995-01-01', o_orderdate) AS x FROM orders))
    SELECT o_orderkey, round(a + b * date_diff('day', DATE '1995-01-01', o_orderdate), 2) AS predicted FROM orders, fit
    """
)
def ols_predictions(spark, folder):
    """Order value predicted from the order's day."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", day.alias("day"))
    _, predicted = S.ols(orders, "day", "o_totalprice")
    return predicted.select("o_orderkey", F.round("predicted", 2).alias("predicted"))


@query(
    "WITH"
    + CALLS_SQL
    + """,
    offsets AS (SELECT policy_end - CAST(o_orderdate AS DATE) AS until_end, CAST(o_orderdate AS DATE) - policy_start AS since_start
                FROM calls WHERE o_orderkey % 7 <> 0),
    kept AS (SELECT * FROM offsets WHERE until_end > 0 AND until_end <= 200)
    SELECT 'until_end' AS edge, CAST(until_end AS BIGINT) AS day, count(*) AS n FROM kept GROUP BY ALL
    UNION ALL
    SELECT 'since_start', CAST(since_start AS BIGINT), count(*) FROM kept WHERE since_start BETWEEN 0 AND 200 GROUP BY ALL
    """
)
def policy_edge(spark, folder):
    """Calls per day before the contract's end and after its start."""
    rows = calls(spark, folder).withColumn("policy_end", unless(F.col("o_orderkey") % 7 == 0, "policy_end"))
    return S.policy_edge(rows, "o_orderdate", "policy_start", "policy_end", 200)


@query(
    "WITH"
    + CALLS_SQL
    + """,
    offsets AS (SELECT policy_end - CAST(o_orderdate AS DATE) AS until_end, CAST(o_orderdate AS DATE) - policy_start AS since_start FROM calls),
    kept AS (SELECT * FROM offsets WHERE until_end > 0 AND until_end <= 730)
    SELECT 'until_end' AS edge, CAST(until_end AS BIGINT) AS day, count(*) AS n FROM kept GROUP BY ALL
    UNION ALL
    SELECT 'since_start', CAST(since_start AS BIGINT), count(*) FROM kept WHERE since_start BETWEEN 0 AND 730 GROUP BY ALL
    """
)
def policy_edge_two_years(spark, folder):
    """The same over the operator's own horizon, every call included."""
    return S.policy_edge(calls(spark, folder), "o_orderdate", "policy_start", "policy_end")


PAIR_COLUMNS = ("high", "error", "odd")


@query(
    """
    WITH d AS (SELECT CAST(value > 20 AS INTEGER) AS high, CAST(event_type = 'error' AS INTEGER) AS error,
                      CASE WHEN event_id % 7 <> 0 THEN CAST(user_id % 2 AS INTEGER) END AS odd FROM events),
    k AS (SELECT * FROM d WHERE odd IS NOT NULL)
    """
    + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS variable1, '{b}' AS variable2, round(corr({a}, {b}), 6) AS correlation FROM k"
        for a in PAIR_COLUMNS
        for b in PAIR_COLUMNS
    )
)
def corr_matrix(spark, folder):
    """Correlations of three flags over complete rows."""
    events = table(spark, folder, "events").select(
        (F.col("value") > 20).alias("high"),
        (F.col("event_type") == "error").alias("error"),
        unless(F.col("event_id") % 7 == 0, F.col("user_id") % 2 == 1).alias("odd"),
    )
    return S.corr_matrix(events, PAIR_COLUMNS).withColumn("correlation", F.round("correlation", 6))


@query(
    """
    SELECT 'Mean' AS statistic, round(avg(value), 6) AS value FROM events UNION ALL
    SELECT 'Median', round(median(value), 6) FROM events UNION ALL
    SELECT 'Q0.1', round(quantile_cont(value, 0.1), 6) FROM events UNION ALL
    SELECT 'Q0.9', round(quantile_cont(value, 0.9), 6) FROM events
    """
)
def summary_stats(spark, folder):
    return S.summary_stats(table(spark, folder, "events"), "value").withColumn("value", F.round("value", 6))


@query(
    """
    WITH s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd, min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)),
    p AS (SELECT lo + (hi - lo) * i / 99 AS x, m, sd FROM s, range(100) r(i))
    SELECT round(x, 6) AS x, round(exp(-(((x - m) / sd) ** 2) / 2) / (sd * sqrt(2 * pi())), 9) AS density FROM p
    """
)
def normal_curve(spark, folder):
    """Normal density fitted to the number of orders per customer."""
    counts = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return S.normal_curve(counts, "n").select(F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))
