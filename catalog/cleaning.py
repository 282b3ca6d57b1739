"""Sources, guards, flags, dates and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import functions as X
from caseloom.operators.dedupe import distinct_rows as distinct
from caseloom.operators.dedupe import first_per_key as first
from caseloom.operators.dedupe import split_last_per_key as split_last
from caseloom.operators.joins import null_if_missing_in
from caseloom.operators.quantiles import remove_outliers as without_outliers
from caseloom.operators.rows import drop_incomplete, reorder
from caseloom.session import scratch_path
from caseloom import sources as S
from catalog.registry import query, unless
from catalog.tables import CALLS_SQL, calls, table

ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)


@query(
    """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE year(o_orderdate) < 1997
    UNION ALL BY NAME
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998
    UNION ALL BY NAME
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE year(o_orderdate) > 1998
    """
)
def read_harmonised(spark, folder):
    """Three inputs that name and order their columns differently."""
    orders = table(spark, folder, "orders")
    year = F.year("o_orderdate")
    plain = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    slices = [
        orders.filter(year < 1997).select(*plain),
        orders.filter(year.between(1997, 1998)).select(
            "o_custkey", F.col("o_orderkey").alias("Order  Key"), "o_totalprice", "o_orderpriority",
            F.lit(None).cast("string").alias("a"), F.lit(1).alias("b"),
        ),
        orders.filter(year > 1998).select(
            F.col("o_orderkey").cast("string").alias("OrderKey"), "o_custkey", F.col("o_totalprice").alias("Total")
        ),
    ]
    base = scratch_path(spark, "slices")
    paths = [S.write_table(part, f"{base}/{i}") for i, part in enumerate(slices)]
    renames = {"Order  Key": "o_orderkey", "OrderKey": "o_orderkey", "Total": "o_totalprice"}
    return S.read_harmonised(spark, paths, ORDERS, renames, ["a", "b"])


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 2 = 0 END AS even, CAST(round(o_totalprice) AS BIGINT) AS whole
    FROM orders
    """
)
def infer_types(spark, folder):
    """Orders as text, with the types found again."""
    orders = table(spark, folder, "orders")
    text = orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.to_date("o_orderdate").cast("string").alias("o_orderdate"),
        unless(F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") % 2 == 0).cast("string")).alias("even"),
        F.round("o_totalprice").alias("whole"),
    )
    return S.infer_types(text)


@query(
    """
    SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority
    FROM orders
    """
)
def write_read_roundtrip(spark, folder):
    """Orders written partitioned as Parquet, then as a delimited file, and read back."""
    orders = table(spark, folder, "orders").withColumn("o_orderpriority", unless(F.col("o_orderkey") % 7 == 0, "o_orderpriority"))
    base = scratch_path(spark, "roundtrip")
    first_hop = S.write_table(orders.select(*ORDERS.fieldNames(), "o_orderstatus"), f"{base}/parquet", partition_by=["o_orderstatus"])
    second = S.write_table(S.read_table(spark, first_hop, ORDERS).fillna("none"), f"{base}/csv", "csv")
    return S.read_csv(spark, second, ORDERS, na_values="none")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
           CASE WHEN o_totalprice BETWEEN 5000 AND 450000 THEN o_totalprice END AS price,
           CASE WHEN year(o_orderdate) BETWEEN 1996 AND 2000 THEN CAST(o_orderdate AS DATE) END AS day,
           TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS BIGINT) AS number
    FROM orders
    """
)
def null_guards(spark, folder):
    orders = table(spark, folder, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string"))
    day = F.to_date("o_orderdate")
    return orders.select(
        "o_orderkey",
        X.null_if("o_orderstatus", ["P"]).alias("status"),
        X.null_outside("o_totalprice", 5000, 450000).alias("price"),
        X.null_outside(day, 1996, 2000, of=F.year(day)).alias("day"),
        X.to_number(text, "bigint").alias("number"),
    )


@query(
    """
    WITH spans AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
             CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_shipdate AS DATE) END AS s,
             CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) - 10 AS e
      FROM lineitem),
    kept AS (SELECT *, CASE WHEN coalesce(e <= s, false) THEN NULL ELSE e END AS end_date FROM spans)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, end_date, CAST(end_date - s AS INTEGER) AS days FROM kept
    """
)
def cross_guard(spark, folder):
    """Ends not after their start are dropped; an unknown start keeps the end."""
    spans = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        unless(F.col("l_orderkey") % 7 == 0, F.to_date("l_shipdate")).alias("s"),
        F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int") - 10).alias("e"),
    )
    kept = spans.withColumn("end_date", X.null_if_not_after("e", "s"))
    return kept.withColumn("days", F.datediff("end_date", "s")).drop("s", "e")


@query(
    """
    SELECT c_custkey,
           CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey % 25 AS INTEGER) ELSE c_nationkey END AS filled,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS segment,
           (SELECT n_nationkey FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3) AS known
    FROM customer
    """
)
def fill_map_codes(spark, folder):
    """Missing values filled, codes mapped, values outside a dimension dropped."""
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation").filter("n_regionkey < 3")
    coded = customers.select(
        "c_custkey",
        X.fill_from(unless(F.col("c_custkey") % 7 == 0, "c_nationkey"), (F.col("c_custkey") % 25).cast("int")).alias("filled"),
        X.map_values("c_mktsegment", {"BUILDING": "B", "MACHINERY": "M"}).alias("segment"),
        F.col("c_nationkey").alias("known"),
    )
    return null_if_missing_in(coded, "known", nations, "n_nationkey")


@query(
    """
    SELECT event_id, event_type IN ('click', 'purchase', 'signup') AS flag, event_type IN ('click', 'signup') AS strict_flag
    FROM events
    """
)
def flags_yes_no(spark, folder):
    """Yes/no text in mixed case, with missing and odd answers."""
    answers = {"click": "yes", "view": "NO", "purchase": "N/A", "signup": "Yes", "error": None}
    answer = F.lit(None).cast("string")
    for kind, text in answers.items():
        answer = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(answer)
    events = table(spark, folder, "events").select("event_id", answer.alias("answer"))
    return events.select("event_id", X.to_flag("answer").alias("flag"), X.to_flag("answer", False).alias("strict_flag"))


@query(
    """
    SELECT event_id, CAST(n AS BIGINT) AS flags_set, round(n / 3, 6) AS score FROM (
      SELECT event_id, CAST(value > 50 AS INTEGER) + CAST(event_type = 'error' AS INTEGER)
             + CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(user_id % 2 = 0 AS INTEGER) END AS n FROM events)
    """
)
def row_scores(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id",
        (F.col("value") > 50).alias("high"),
        (F.col("event_type") == "error").alias("failed"),
        unless(F.col("event_id") % 7 == 0, F.col("user_id") % 2 == 0).alias("even"),
    )
    flags = ["high", "failed", "even"]
    return events.select("event_id", X.row_sum(flags).alias("flags_set"), F.round(X.row_mean(flags), 6).alias("score"))


@query(
    """
    SELECT event_id, event_type, value FROM events
    WHERE event_type IN ('error', 'purchase', 'view') AND user_id NOT IN (1, 2, 3) AND event_id % 7 <> 0
      AND value BETWEEN 5 AND 60
    """
)
def filters(spark, folder):
    events = table(spark, folder, "events").withColumn("known", unless(F.col("event_id") % 7 == 0, "event_type"))
    kept = events.filter(
        F.col("event_type").isin("error", "purchase", "view")
        & ~F.col("user_id").isin(1, 2, 3)
        & F.col("known").isNotNull()
        & F.col("value").between(5, 60)
    )
    return kept.select("event_id", "event_type", "value")


@query(
    """
    SELECT count(*) FILTER (WHERE event_id % 7 <> 0 AND user_id % 11 <> 0) AS kept,
           count(*) FILTER (WHERE event_id % 7 = 0 OR user_id % 11 = 0) AS dropped,
           count(*) FILTER (WHERE event_id % 7 = 0) AS missing_value,
           count(*) FILTER (WHERE user_id % 11 = 0) AS missing_event_type,
           count(*) FILTER (WHERE event_id % 7 <> 0 AND user_id % 11 <> 0) AS rows_left
    FROM events
    """
)
def drop_incomplete_report(spark, folder):
    """How many rows lack a value, and how many are left."""
    events = table(spark, folder, "events").select(
        "event_id",
        unless(F.col("event_id") % 7 == 0, "value").alias("value"),
        unless(F.col("user_id") % 11 == 0, "event_type").alias("event_type"),
    )
    left, counts = drop_incomplete(events, ["value", "event_type"])
    return counts.withColumn("rows_left", left.agg(F.count(F.lit(1))).scalar())


@query(
    """
    SELECT o_orderkey,
           CASE WHEN o_totalprice > 0 AND o_totalprice <= 450000
                THEN concat_ws('-', CAST(ceil(o_totalprice / 25000) - 1 AS BIGINT) * 25000, CAST(ceil(o_totalprice / 25000) AS BIGINT) * 25000) END AS bin,
           CASE WHEN x > 0 AND x <= 200
                THEN concat_ws('-', CAST(ceil(x / 20) - 1 AS BIGINT) * 20, CAST(ceil(x / 20) AS BIGINT) * 20) END AS right_closed,
           CASE WHEN x >= 0 AND x < 200
                THEN concat_ws('-', CAST(floor(x / 20) AS BIGINT) * 20, CAST(floor(x / 20) AS BIGINT) * 20 + 20) END AS left_closed
    FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 260 END AS x FROM orders)
    """
)
def bin_fixed(spark, folder):
    """Equal-width bins; whole numbers hit the edges."""
    orders = table(spark, folder, "orders").withColumn("x", unless(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 260))
    return orders.select(
        "o_orderkey",
        X.bin_fixed("o_totalprice", 0, 450_000, 25_000).alias("bin"),
        X.bin_fixed("x", 0, 200, 20).alias("right_closed"),
        X.bin_fixed("x", 0, 200, 20, right=False).alias("left_closed"),
    )


@query(
    """
    WITH amounts AS (SELECT o_orderkey, o_totalprice * (1 + o_orderkey % 10 // 9 * 2) AS amount FROM orders),
    q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM amounts)
    SELECT o_orderkey, round(amount, 2) AS amount FROM amounts, q
    WHERE amount >= q1 - 1.5 * (q3 - q1) AND amount <= q3 + 1.5 * (q3 - q1)
    """
)
def remove_outliers(spark, folder):
    """Order values, some tripled, within the quartile fences."""
    factor = F.when(F.col("o_orderkey") % 10 == 9, 3).otherwise(1)
    amounts = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") * factor).alias("amount"))
    return without_outliers(amounts, "amount").withColumn("amount", F.round("amount", 2))


@query(
    """
    WITH texts AS (
      SELECT o_orderkey, CASE o_orderkey % 6
        WHEN 0 THEN day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate)
        WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d')
        WHEN 3 THEN '28/05/2921' WHEN 4 THEN 'x' END AS t FROM orders),
    parsed AS (SELECT o_orderkey, coalesce(try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%Y%m%d')) AS d FROM texts)
    SELECT o_orderkey, CASE WHEN year(d) BETWEEN 1678 AND 2261 THEN CAST(d AS DATE) END AS day FROM parsed
    """
)
def parse_dates(spark, folder):
    """Dates in two formats, some out of range or no dates."""
    day = F.col("o_orderdate")
    texts = [
        F.concat_ws("/", F.dayofmonth(day), F.month(day), F.year(day)),
        F.date_format(day, "dd/MM/yyyy"),
        F.date_format(day, "yyyyMMdd"),
        F.lit("28/05/2921"),
        F.lit("x"),
    ]
    text = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(F.col("o_orderkey") % 6 == i, t).otherwise(text)
    return table(spark, folder, "orders").select("o_orderkey", X.parse_date(text).alias("day"))


@query(
    """
    WITH texts AS (
      SELECT event_id, CAST(ts AS DATE) AS d, CASE event_id % 5
        WHEN 0 THEN hour(ts) || ':' || strftime(ts, '%M') WHEN 1 THEN strftime(ts, '%H:%M') WHEN 2 THEN '0'
        WHEN 3 THEN hour(ts) || ':' || second(ts) % 10 END AS t FROM events),
    good AS (SELECT *, CASE WHEN regexp_matches(t, '^\\d{1,2}:\\d{2}$') THEN lpad(t, 5, '0') || ':00' END AS time FROM texts)
    SELECT event_id, time, d + CAST(time AS TIME) AS at FROM good
    """
)
def parse_times(spark, folder):
    """Times of day in loose notation, joined with their date."""
    at = F.col("ts")
    texts = [
        F.concat_ws(":", F.hour(at), F.date_format(at, "mm")),
        F.date_format(at, "HH:mm"),
        F.lit("0"),
        F.concat_ws(":", F.hour(at), F.second(at) % 10),
    ]
    text = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(F.col("event_id") % 5 == i, t).otherwise(text)
    events = table(spark, folder, "events").select("event_id", F.to_date("ts").alias("d"), X.normalise_time(text).alias("time"))
    return events.select("event_id", "time", X.at_time("d", "time").alias("at"))


@query(
    """
    WITH gaps AS (SELECT event_id, floor((event_id % 1000 - 200) / 60) AS m FROM events)
    SELECT event_id, CASE WHEN m > 0 THEN CAST(m AS BIGINT) END AS minutes,
           CAST(floor((event_id % 1000 - 200) / 86.4) AS BIGINT) AS days FROM gaps
    """
)
def minutes_between(spark, folder):
    """Whole minutes and floored days between two moments, some of them reversed."""
    shift = (F.col("event_id") % 1000 - 200).cast("int")
    events = table(spark, folder, "events").select(
        "event_id",
        "ts",
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), shift.cast("decimal(18,6)"))).alias("soon"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (shift * 1000).cast("decimal(18,6)"))).alias("late"),
    )
    return events.select(
        "event_id", X.minutes_between("ts", "soon").alias("minutes"), X.floor_days("ts", "late").alias("days")
    )


@query(
    "WITH"
    + CALLS_SQL
    + """,
    edges AS (SELECT o_orderkey, o_orderdate AS t, CASE WHEN o_orderkey % 7 <> 0 THEN policy_start END AS s,
                     CASE WHEN o_orderkey % 11 <> 0 THEN policy_end END AS e FROM calls)
    SELECT o_orderkey, coalesce(t >= s AND t <= s + INTERVAL 30 DAY, false) OR coalesce(t >= e - INTERVAL 30 DAY, false)
           OR coalesce(t > e, false) AS at_edge FROM edges
    """
)
def contract_edge(spark, folder):
    """Calls near the start or end of a contract, with unknown dates."""
    rows = calls(spark, folder).withColumns(
        {
            "policy_start": unless(F.col("o_orderkey") % 7 == 0, "policy_start"),
            "policy_end": unless(F.col("o_orderkey") % 11 == 0, "policy_end"),
        }
    )
    return rows.select("o_orderkey", X.near_contract_edge("o_orderdate", "policy_start", "policy_end").alias("at_edge"))


@query(
    """
    SELECT event_id, year(ts) AS y, month(ts) AS m, CAST(ts AS DATE) AS day, CAST(ts AS DATE) + 7 AS week_on,
           CAST(ts AS DATE) - 30 AS month_back, CAST(CAST(ts AS DATE) - DATE '2024-01-15' AS INTEGER) AS distance FROM events
    """
)
def date_parts(spark, folder):
    day = F.to_date("ts")
    return table(spark, folder, "events").select(
        "event_id",
        F.year("ts").cast("bigint").alias("y"),
        F.month("ts").cast("bigint").alias("m"),
        day.alias("day"),
        F.date_add(day, 7).alias("week_on"),
        F.date_sub(day, 30).alias("month_back"),
        F.datediff(day, F.lit("2024-01-15").cast("date")).alias("distance"),
    )


@query(
    """
    SELECT c_custkey, upper(c_name) AS loud, lower(c_mktsegment) AS quiet,
           CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || '_' || c_nationkey END AS id FROM customer
    """
)
def text_forms(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.upper("c_name").alias("loud"),
        F.lower("c_mktsegment").alias("quiet"),
        X.numbered_id(unless(F.col("c_custkey") % 7 == 0, "c_mktsegment"), "c_nationkey").alias("id"),
    )


@query("SELECT DISTINCT CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey END AS k, l_linenumber FROM lineitem")
def distinct_rows(spark, folder):
    """Whole-row distinct; missing values equal each other."""
    lines = table(spark, folder, "lineitem").select(unless(F.col("l_orderkey") % 7 == 0, "l_orderkey").alias("k"), "l_linenumber")
    return distinct(lines)


@query(
    """
    SELECT k, o_orderkey, o_orderdate, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderdate, o_orderkey) AS rn
      FROM (SELECT *, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS k FROM orders)) WHERE rn = 1
    """
)
def first_per_key(spark, folder):
    orders = table(spark, folder, "orders").withColumn("k", unless(F.col("o_custkey") % 7 == 0, "o_custkey"))
    return first(orders, ["k"], ["o_orderdate", "o_orderkey"]).select("k", "o_orderkey", "o_orderdate", "o_totalprice")


@query(
    """
    SELECT o_orderkey, o_custkey, CASE WHEN rn = 1 THEN 'last' ELSE 'rest' END AS part FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    """
)
def split_last_per_key(spark, folder):
    """Each customer's last order, and all the others."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    last, rest = split_last(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    parts = last.withColumn("part", F.lit("last")).unionByName(rest.withColumn("part", F.lit("rest")))
    return parts.drop("o_orderdate")


@query("SELECT c_mktsegment AS segment, c_custkey, c_name, c_acctbal FROM customer")
def columns_first(spark, folder):
    """Columns renamed, dropped and reordered, the rest appended."""
    customers = table(spark, folder, "customer").withColumnsRenamed({"c_mktsegment": "segment"}).drop("c_nationkey")
    return reorder(customers, ["segment", "c_custkey"])
