"""Counts, quantiles, histograms and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import aggregate as A
from caseloom.operators import quantiles as Q
from catalog.registry import query, unless
from catalog.tables import table


@query(
    """
    SELECT k AS event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM (SELECT CASE WHEN event_id % 7 <> 0 THEN event_type END AS k FROM events) WHERE k IS NOT NULL GROUP BY k
    """
)
def value_counts(spark, folder):
    """Events per type with their share, the missing left out."""
    events = table(spark, folder, "events").select(unless(F.col("event_id") % 7 == 0, "event_type").alias("event_type"))
    counts = A.value_counts(events, "event_type", normalize=True).withColumn("share", F.round("share", 6))
    return A.most_common(counts)


@query(
    """
    SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS sum_failed,
           round(sum(value), 2) AS sum_value, round(avg(value), 6) AS mean_value
    FROM events GROUP BY user_id
    """
)
def entity_aggregates(spark, folder):
    events = table(spark, folder, "events").withColumn("failed", F.col("event_type") == "error")
    per_user = A.entity_aggregates(events, ["user_id"], sums=["failed", "value"], means=["value"])
    return per_user.withColumns({"sum_value": F.round("sum_value", 2), "mean_value": F.round("mean_value", 6)})


@query(
    """
    SELECT user_id, count(DISTINCT CASE WHEN event_id % 7 <> 0 THEN event_type END) AS n_unique FROM events GROUP BY user_id
    """
)
def n_unique(spark, folder):
    events = table(spark, folder, "events").withColumn("event_type", unless(F.col("event_id") % 7 == 0, "event_type"))
    return A.n_unique(events, ["user_id"], "event_type")


@query("SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 30 GROUP BY user_id")
def filtered_count(spark, folder):
    events = table(spark, folder, "events")
    return A.filtered_count(events, ["user_id"], (F.col("event_type") == "error") & (F.col("value") > 30), "errors")


@query(
    """
    SELECT 'all' AS status, round(quantile_cont(o_totalprice, 0.1), 4) AS q10, round(median(o_totalprice), 4) AS q50,
           round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM orders
    UNION ALL
    SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.1), 4), round(median(o_totalprice), 4),
           round(quantile_cont(o_totalprice, 0.9), 4) FROM orders GROUP BY 1
    """
)
def quantiles(spark, folder):
    """Exact quantiles of order values, overall and by status."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderstatus", "status")
    ps, names = (0.1, 0.5, 0.9), ("q10", "q50", "q90")
    overall = Q.quantiles(orders, "o_totalprice", ps, names=names).withColumn("status", F.lit("all"))
    both = overall.unionByName(Q.quantiles(orders, "o_totalprice", ps, by=["status"], names=names))
    return both.select("status", *[F.round(n, 4).alias(n) for n in names])


@query(
    """
    SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS z FROM events
    """
)
def zscore(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return A.zscore(events, "value", "z").select("event_id", F.round("z", 6).alias("z"))


@query(
    """
    WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), e AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT event_id, n.n >= (SELECT quantile_cont(n, 0.8) FROM n) AS busy,
           coalesce(e.n > (SELECT quantile_cont(n, 0.75) FROM e), false) AS failing
    FROM events JOIN n USING (user_id) LEFT JOIN e USING (user_id)
    """
)
def flag_top_quantile(spark, folder):
    """Events of the busiest users, and of those with most errors."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    rows = F.count(F.lit(1))
    flagged = Q.flag_top_quantile(events, "user_id", rows, 0.8, "busy")
    flagged = Q.flag_top_quantile(flagged, "user_id", rows, 0.75, "failing", strict=True, among=F.col("event_type") == "error")
    return flagged.select("event_id", "busy", "failing")


NICE_STEP = """
nice AS (SELECT min(s) AS step FROM (SELECT m * pow(10.0, e) AS s FROM range(-3, 9) r(e), (VALUES (1), (2), (5)) v(m)),
         (SELECT max(x) - min(x) AS span FROM data) WHERE span / s <= {bins})"""


@query(
    "WITH data AS (SELECT o_totalprice AS x FROM orders),"
    + NICE_STEP.format(bins=40)
    + """
    SELECT floor(x / step) * step AS bin_start, (floor(x / step) + 1) * step AS bin_end, count(*) AS n FROM data, nice GROUP BY ALL
    """
)
def histogram_round_bins(spark, folder):
    """Order values in at most forty bins of a round width."""
    return A.histogram(table(spark, folder, "orders"), "o_totalprice", maxbins=40)


@query(
    """
    SELECT event_type, floor(value / 5) * 5 AS bin_start, floor(value / 5) * 5 + 5 AS bin_end, count(*) AS n
    FROM events WHERE event_type <> 'view' GROUP BY ALL
    """
)
def histogram_fixed_step(spark, folder):
    """Event values in bins of five by type."""
    events = table(spark, folder, "events").withColumn("event_type", unless(F.col("event_type") == "view", "event_type"))
    return A.histogram(events, "value", step=5, by=["event_type"])


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL")
def stacked_counts(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_orderstatus", unless(F.col("o_orderkey") % 7 == 0, "o_orderstatus"))
    return A.value_counts(orders, ["o_orderpriority", "o_orderstatus"])


@query(
    """
    WITH k AS (SELECT event_type AS a, CASE WHEN event_id % 2 = 0 OR event_type <> 'view' THEN 'h' || hour(ts) END AS b FROM events),
    d AS (SELECT a, b, count(*) AS n FROM k WHERE b IS NOT NULL GROUP BY ALL)
    SELECT a, b, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY a) AS BIGINT) AS row_total
    FROM (SELECT DISTINCT a FROM d) CROSS JOIN (SELECT DISTINCT b FROM d) LEFT JOIN d USING (a, b)
    """
)
def crosstab(spark, folder):
    """Event types by hour, empty combinations included."""
    hour = F.concat(F.lit("h"), F.hour("ts").cast("string"))
    kept = (F.col("event_id") % 2 == 0) | (F.col("event_type") != "view")
    events = table(spark, folder, "events").select(F.col("event_type").alias("a"), F.when(kept, hour).alias("b"))
    return A.ordered_crosstab(events, "a", "b")


@query(
    """
    WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS m,
                      quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
    SELECT o_orderstatus, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3,
           min(o_totalprice) AS whisker_low, max(o_totalprice) AS whisker_high
    FROM orders JOIN q USING (o_orderstatus)
    WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL
    """
)
def box_stats(spark, folder):
    """Box-plot summary of order values by status."""
    summary = Q.box_stats(table(spark, folder, "orders"), "o_totalprice", ["o_orderstatus"])
    return summary.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query(
    """
    SELECT 'month' AS bucket, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n, NULL AS quarter FROM orders GROUP BY ALL
    UNION ALL
    SELECT 'quarter', CAST(date_trunc('quarter', o_orderdate) AS DATE), count(*), NULL FROM orders GROUP BY ALL
    UNION ALL
    SELECT 'quarter_month', CAST(date_trunc('month', o_orderdate) AS DATE), count(*), quarter(o_orderdate) FROM orders GROUP BY ALL
    """
)
def timeline(spark, folder):
    """Orders per month and per quarter."""
    orders = table(spark, folder, "orders")
    parts = [A.timeline(orders, "o_orderdate", b).withColumn("bucket", F.lit(b)) for b in A.TIMELINE_BUCKETS]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return stacked.withColumn("quarter", F.col("quarter").cast("bigint"))


@query(
    """
    SELECT l_returnflag, feature, round(sum(value), 2) AS total FROM (
      SELECT l_returnflag, unnest([{'f': 'cut', 'v': l_discount - 0.05}, {'f': 'quantity', 'v': l_quantity - 25}], recursive := true)
      FROM lineitem) t(l_returnflag, feature, value)
    WHERE value > 0 GROUP BY ALL
    """
)
def melt_sum(spark, folder):
    """Sums of the positive parts of two measures by return flag."""
    lines = table(spark, folder, "lineitem").select(
        "l_returnflag", (F.col("l_discount") - 0.05).alias("cut"), (F.col("l_quantity") - 25).alias("quantity")
    )
    return A.melt_sum(lines, ["l_returnflag"], ["cut", "quantity"]).withColumn("total", F.round("total", 2))


@query(
    """
    WITH long AS (
      SELECT l_returnflag, unnest([{'f': 'l_quantity', 'v': l_quantity}, {'f': 'l_discount', 'v': l_discount},
             {'f': 'l_extendedprice', 'v': CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END}], recursive := true) FROM lineitem)
    SELECT f AS feature, l_returnflag, 'Mean' AS kind, round(avg(v), 4) AS value FROM long GROUP BY ALL
    UNION ALL
    SELECT f, l_returnflag, 'Median', round(median(v), 4) FROM long GROUP BY ALL
    """
)
def profile_groups(spark, folder):
    """Mean and median of three measures by return flag."""
    lines = table(spark, folder, "lineitem").withColumn("l_extendedprice", unless(F.col("l_orderkey") % 7 == 0, "l_extendedprice"))
    profile = A.profile_groups(lines, "l_returnflag", ["l_quantity", "l_discount", "l_extendedprice"])
    return profile.withColumn("value", F.round("value", 4))


@query(
    """
    WITH long AS (
      SELECT o_orderstatus, unnest([{'f': 'o_orderpriority', 'v': CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END},
             {'f': 'costly', 'v': CAST(o_totalprice > 300000 AS VARCHAR)}], recursive := true) FROM orders)
    SELECT f AS feature, o_orderstatus, v AS level, n, round(n / sum(n) OVER (PARTITION BY f, o_orderstatus), 6) AS share
    FROM (SELECT f, o_orderstatus, v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL)
    """
)
def profile_nominal(spark, folder):
    """Shares of priorities and of costly orders by status."""
    orders = table(spark, folder, "orders").withColumns(
        {
            "o_orderpriority": unless(F.col("o_orderkey") % 7 == 0, "o_orderpriority"),
            "costly": F.col("o_totalprice") > 300000,
        }
    )
    return A.profile_nominal(orders, "o_orderstatus", ["o_orderpriority", "costly"]).withColumn("share", F.round("share", 6))


@query(
    """
    SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS type_click, count(*) FILTER (WHERE event_type = 'error') AS type_error,
           count(*) FILTER (WHERE event_type = 'purchase') AS type_purchase, count(*) FILTER (WHERE event_type = 'signup') AS type_signup,
           count(*) FILTER (WHERE event_type = 'view') AS type_view
    FROM events GROUP BY user_id
    """
)
def pivot_counts(spark, folder):
    """Events of each type per user; the types are found first."""
    return A.pivot_counts(table(spark, folder, "events"), "user_id", "event_type", prefix="type_")


@query(
    """
    SELECT o_orderstatus, o_orderpriority, service, offered, count(*) AS n FROM (
      SELECT o_orderstatus, o_orderpriority, unnest([{'s': 'costly', 'o': CAST(o_totalprice > 300000 AS VARCHAR)},
             {'s': 'odd', 'o': CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 2 = 1 AS VARCHAR) END}], recursive := true)
      FROM orders) t(o_orderstatus, o_orderpriority, service, offered)
    WHERE offered IS NOT NULL GROUP BY ALL
    """
)
def service_influence(spark, folder):
    """Orders by status, priority, service and whether it applied."""
    orders = table(spark, folder, "orders").select(
        "o_orderstatus",
        "o_orderpriority",
        (F.col("o_totalprice") > 300000).cast("string").alias("costly"),
        unless(F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") % 2 == 1).cast("string")).alias("odd"),
    )
    return A.service_influence(orders, ["o_orderstatus", "o_orderpriority"], ["costly", "odd"])


# Words left out of the report.
STOPWORDS = "the of and to in is on that by at der die das und le la les de et un une el los y que"


@query(
    f"""
    SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents)
    WHERE NOT regexp_matches(word, '^\\p{{Nd}}+$') AND word NOT IN (SELECT unnest(string_split('{STOPWORDS}', ' ')))
    GROUP BY word ORDER BY n DESC, word LIMIT 200
    """
)
def top_words(spark, folder):
    """The two hundred most frequent words of all documents."""
    stopwords = spark.createDataFrame([(w.upper(),) for w in STOPWORDS.split()], "stopwords string")
    return A.top_words(table(spark, folder, "documents", busy=True), "text", 200, stopwords)


@query(
    """
    SELECT * FROM (
      SELECT p_brand, p_partkey, round(gap, 4) AS gap,
             CAST(row_number() OVER (PARTITION BY p_brand ORDER BY abs(gap) DESC, p_partkey) AS INTEGER) AS rank
      FROM (SELECT *, p_retailprice - p_size * 50 AS gap FROM part)) WHERE rank <= 5
    """
)
def top_n_abs(spark, folder):
    """The five parts per brand whose price is farthest from what their size suggests."""
    parts = table(spark, folder, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") - F.col("p_size") * 50).alias("gap"))
    return A.top_n_abs(parts, "p_brand", "gap", 5, "p_partkey").withColumn("gap", F.round("gap", 4))
