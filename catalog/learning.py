"""Feature rows, encoding, clustering and classification."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import sources as S
from caseloom.operators import aggregate as A
from caseloom.operators import classify as C
from caseloom.operators import cluster as K
from caseloom.operators import features as M
from caseloom.plans import cases
from caseloom.session import scratch_path
from catalog.registry import query, unless
from catalog.tables import CALLS, CASES_SQL, REPAIRS_SQL, calls, repair_lines, table

STATUSES = ["F", "O", "P"]


def _features(spark, folder):
    """One row per customer from orders as calls and shipments as repairs."""
    rows = cases.add_cases(calls(spark, folder), CALLS, 90)
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    priorities = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    rows = rows.join(priorities, "o_orderkey").join(customers, "o_custkey")
    rows, _ = M.label_encode(rows, "c_mktsegment", "segment_code")
    lines, _ = repair_lines(spark, folder)
    return M.entity_features(
        rows,
        lines,
        "o_custkey",
        "o_orderdate",
        "gap_days",
        {"rental_days": "rental_days"},
        CALLS.services,
        "policy_start",
        {"segment_code": "segment_code", "o_orderkey": "first_order"},
        {"o_orderstatus": STATUSES, "o_orderpriority": None},
        "line_id",
        "l_orderkey",
        ["o_orderdate", "o_orderkey"],
    )


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NUMBERS = [
    "calls", "mean_gap", "rental_days", "services", "first_year", "repairs", "stays", "segment_code",
    *[f"o_orderstatus: {s}" for s in STATUSES], *[f"o_orderpriority: {p}" for p in PRIORITIES],
]


def _counts_sql(col: str, levels: list[str]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {col} = '{level}') AS \"{col}: {level}\"" for level in levels)


FEATURES_SQL = (
    "WITH"
    + CASES_SQL
    + ","
    + REPAIRS_SQL
    + f""",
    r AS (SELECT o_custkey, count(line_id) AS repairs, count(DISTINCT l_orderkey) AS stays FROM repairs GROUP BY 1),
    c AS (SELECT cases.*, o_orderpriority, c_mktsegment FROM cases JOIN (SELECT o_orderkey, o_orderpriority FROM orders) USING (o_orderkey)
          JOIN customer ON c_custkey = o_custkey),
    codes AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM c)),
    firsts AS (SELECT o_custkey, o_orderkey AS first_order FROM (SELECT *, row_number() OVER (
                 PARTITION BY o_custkey ORDER BY policy_start, o_orderdate, o_orderkey) AS rn FROM c) WHERE rn = 1)
    SELECT o_custkey, count(o_orderdate) AS calls, round(avg(coalesce(gap_days, 0)), 6) AS mean_gap, sum(rental_days) AS rental_days,
           CAST(sum(CAST(urgent AS INTEGER) + CAST(costly AS INTEGER) + CAST(odd AS INTEGER)) AS BIGINT) AS services,
           year(min(policy_start)) AS first_year, coalesce(any_value(repairs), 0) AS repairs, coalesce(any_value(stays), 0) AS stays,
           any_value(code) AS segment_code, any_value(first_order) AS first_order,
           {_counts_sql("o_orderstatus", STATUSES)}, {_counts_sql("o_orderpriority", PRIORITIES)}
    FROM c JOIN codes USING (c_mktsegment) JOIN firsts USING (o_custkey) LEFT JOIN r USING (o_custkey) GROUP BY o_custkey
    """
)


@query(FEATURES_SQL)
def entity_features(spark, folder):
    """Counts, sums, first values, pivots and repairs per customer."""
    return _features(spark, folder).withColumns({"mean_gap": F.round("mean_gap", 6), "first_year": F.col("first_year").cast("bigint")})


@query(
    """
    WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE c_mktsegment END AS segment FROM customer)
    SELECT c_custkey, segment, dense_rank() OVER (ORDER BY segment) - 1 AS code, segment AS decoded FROM c
    """
)
def label_encode(spark, folder):
    """Segments numbered in sorted order, and the labels found again."""
    customers = table(spark, folder, "customer").select("c_custkey", unless(F.col("c_custkey") % 7 == 0, "c_mktsegment").alias("segment"))
    coded, model = M.label_encode(customers, "segment", "code", missing="none")
    return M.label_decode(coded, "code", "decoded", model)


@query(
    """
    WITH k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (
                 SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'AUTOMOBILE'))
    SELECT c_custkey, c_mktsegment AS segment, coalesce(code, (SELECT count(*) FROM k)) AS code FROM customer LEFT JOIN k USING (c_mktsegment)
    """
)
def encode_saved(spark, folder):
    """Segments numbered by saved codes, which lack the first one in sorted order."""
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    known = customers.filter((F.col("c_custkey") % 2 == 0) & (F.col("segment") != "AUTOMOBILE"))
    path = S.write_table(M.label_codes(known, "segment"), scratch_path(spark, "saved-codes"))
    return M.encode_labels(customers, "segment", "code", spark.read.parquet(path))


@query(
    """
    WITH p AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS code FROM (SELECT DISTINCT l_partkey FROM lineitem)),
    c AS (SELECT l_suppkey, code, count(*) AS n FROM lineitem JOIN p USING (l_partkey) GROUP BY ALL)
    SELECT l_suppkey, string_agg(code, ',' ORDER BY code) AS codes, string_agg(n, ',' ORDER BY code) AS counts FROM c GROUP BY l_suppkey
    """
)
def sparse_pivot(spark, folder):
    """Lines of every part per supplier, as sparse rows."""
    counts, _ = M.sparse_counts(table(spark, folder, "lineitem"), "l_suppkey", "l_partkey")
    spelled = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("codes", "counts")}
    return counts.withColumns(spelled)


@query(
    """
    SELECT o_orderkey, CAST(('0x' || substr(md5('42-' || o_orderkey), 1, 8)) AS BIGINT) % 100 < 70 AS training FROM orders
    """
)
def split_hash(spark, folder):
    """A 70/30 split that depends on the key only."""
    train, test = C.hash_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("training", F.lit(True)).unionByName(test.withColumn("training", F.lit(False)))


@query(
    """
    WITH c AS (SELECT *, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance FROM customer),
    m AS (SELECT segment AS mode FROM c WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
    SELECT c_custkey, coalesce(segment, mode) AS segment, round(coalesce(balance, avg(balance) OVER ()), 4) AS balance FROM c, m
    """
)
def impute(spark, folder):
    """Missing segments by the most frequent one, missing balances by the mean."""
    from pyspark.ml.feature import Imputer

    customers = table(spark, folder, "customer").select(
        "c_custkey",
        unless(F.col("c_custkey") % 3 == 0, "c_mktsegment").alias("segment"),
        unless(F.col("c_custkey") % 7 == 0, "c_acctbal").alias("balance"),
    )
    mode = C.modes(customers, ["segment"]).select("mode").scalar()
    filled = Imputer(strategy="mean", inputCols=["balance"], outputCols=["full"]).fit(customers).transform(customers)
    return filled.select("c_custkey", F.coalesce("segment", mode).alias("segment"), F.round("full", 4).alias("balance"))


@query(
    """
    WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS b FROM customer),
    f AS (SELECT c_custkey, coalesce(b, avg(b) OVER ()) AS b FROM c)
    SELECT c_custkey, round((b - avg(b) OVER ()) / stddev_samp(b) OVER (), 6) AS scaled FROM f
    """
)
def standard_scale(spark, folder):
    """Balances, the missing ones as the mean, in standard deviations."""
    customers = table(spark, folder, "customer").select("c_custkey", unless(F.col("c_custkey") % 7 == 0, "c_acctbal").alias("balance"))
    return C.standard_scale(customers, ["balance"]).select("c_custkey", F.round("balance_scaled", 6).alias("scaled"))


@query("SELECT c_custkey, round(c_acctbal / max(abs(c_acctbal)) OVER (), 6) AS scaled FROM customer")
def max_abs_scale(spark, folder):
    """Balances divided by the largest absolute one."""
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    return K.max_abs_scale(customers, ["balance"]).select("c_custkey", F.round("balance_scaled", 6).alias("scaled"))


@query(
    """
    SELECT doc_id, CAST(lang = 'de' AS INTEGER) AS de, CAST(lang = 'en' AS INTEGER) AS en, CAST(lang = 'es' AS INTEGER) AS es
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN (
            SELECT lang FROM documents WHERE doc_id % 7 <> 0 AND lang <> 'fr' GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
          ELSE lang END AS lang FROM documents)
    """
)
def one_hot(spark, folder):
    """Languages as 0/1 columns; French is unknown to the training rows."""
    documents = table(spark, folder, "documents").select("doc_id", unless(F.col("doc_id") % 7 == 0, "lang").alias("lang"))
    encoded = C.one_hot(documents, documents.filter((F.col("lang") != "fr") | F.col("lang").isNull()), ["lang"])
    places = {"de": 0, "en": 1, "es": 2}
    return encoded.select("doc_id", *[F.col("encoded")[i].cast("int").alias(lang) for lang, i in places.items()])


RANKED_SQL = """
WITH s AS (SELECT round(o_totalprice / 10000) AS score, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label FROM orders),
g AS (SELECT score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY 1),
r AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp FROM g)
"""


def _scored(spark, folder):
    return table(spark, folder, "orders").select(
        F.round(F.col("o_totalprice") / 10000).alias("score"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("label"),
        (F.col("o_totalprice") > 300000).cast("int").alias("prediction"),
    )


@query(RANKED_SQL + "SELECT threshold, round(fp / (SELECT sum(neg) FROM g), 6) AS fpr, round(tp / (SELECT sum(pos) FROM g), 6) AS tpr FROM r")
def roc_curve(spark, folder):
    """Rates at each score if dear orders were called urgent."""
    curve = C.roc_curve(_scored(spark, folder), "score", "label")
    return curve.withColumns({"fpr": F.round("fpr", 6), "tpr": F.round("tpr", 6)})


@query(RANKED_SQL + "SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM r")
def roc_auc(spark, folder):
    return C.roc_auc(_scored(spark, folder), "score", "label").select(F.round("auc", 6).alias("auc"))


CONFUSED_SQL = """
WITH s AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label, CAST(o_totalprice > 300000 AS INTEGER) AS prediction FROM orders)
"""


@query(CONFUSED_SQL + "SELECT label, prediction, count(*) AS n FROM s GROUP BY ALL")
def confusion(spark, folder):
    return C.confusion(_scored(spark, folder), "label", "prediction")


@query(
    CONFUSED_SQL
    + """,
    k AS (SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS called,
                 count(*) FILTER (WHERE label = c AND prediction = c) AS hits FROM s, (VALUES (0), (1)) v(c) GROUP BY c)
    SELECT c AS class, round(hits / called, 6) AS precision, round(hits / support, 6) AS recall,
           round(2 * hits / (called + support), 6) AS f1, support FROM k
    """
)
def classification_report(spark, folder):
    report = C.classification_report(_scored(spark, folder), "label", "prediction")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _kept_features(spark, folder):
    """Feature rows as a written table: fits and scores pass over it many times."""
    path = S.write_table(_features(spark, folder), scratch_path(spark, "features"))
    features = spark.read.parquet(path)
    names = [f"f{i}" for i in range(len(NUMBERS))]
    return features.select("o_custkey", *[F.col(f"`{n}`").cast("double").alias(p) for n, p in zip(NUMBERS, names)]), names


def _named(df):
    """The feature names behind the short ones Spark ML gets."""
    table_of = F.create_map(*[F.lit(x) for i, n in enumerate(NUMBERS) for x in (f"f{i}", n)])
    return df.withColumn("feature", table_of[F.col("feature")])


@query()
def pca_variance(spark, folder):
    """Variance explained by each component of the scaled features."""
    return K.pca_variance(*_kept_features(spark, folder))


@query()
def pca_loadings(spark, folder):
    """The five features that weigh most in each component kept."""
    frame, names = _kept_features(spark, folder)
    return _named(K.top_loadings(K.fit_clusters(frame, names).loadings))


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").withColumn(K.COMPONENTS, array_to_vector("embedding"))


@query()
def kmeans_silhouette(spark, folder):
    """Mean silhouette for two to seven clusters of embeddings."""
    vectors = _vectors(spark, folder).select(K.COMPONENTS).persist()
    try:
        return K.silhouette_by_k(vectors)
    finally:
        vectors.unpersist()


@query(
    """
    WITH v AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)),
    sums AS (SELECT label, i, sum(x) AS total FROM v GROUP BY ALL),
    sizes AS (SELECT label, count(DISTINCT vec_id) AS n, sum(x * x) AS norm2 FROM v GROUP BY 1),
    dots AS (SELECT vec_id, v.label AS own, s.label AS other, sum(x * total) AS dot, sum(x * x) AS self FROM v JOIN sums s USING (i) GROUP BY ALL),
    dist AS (SELECT vec_id, own, other, n, self + norm2 / n - 2 * dot / n AS d FROM dots JOIN sizes ON label = other),
    ab AS (SELECT vec_id, min(CASE WHEN own = other AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM dist GROUP BY 1)
    SELECT vec_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab
    """
)
def sample_silhouette(spark, folder):
    """Silhouette of every embedding with its label as cluster."""
    scored = K.sample_silhouette(_vectors(spark, folder), K.COMPONENTS, "label")
    return scored.select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query()
def cluster_predict(spark, folder):
    """Customers with their cluster, by a model that was saved and loaded."""
    frame, names = _kept_features(spark, folder)
    fitted = K.fit_clusters(frame, names)
    path = S.save_model(fitted.model, scratch_path(spark, "clusters"))
    return K.predict_clusters(S.load_model(path), frame).select("o_custkey", K.CLUSTER)


@query()
def cluster_profile(spark, folder):
    """Mean and median of every feature per cluster."""
    frame, names = _kept_features(spark, folder)
    fitted = K.fit_clusters(frame, names)
    clustered = K.predict_clusters(fitted.model, frame)
    return _named(K.profile_groups(clustered, K.CLUSTER, names))


MEASURES = [n for n in NUMBERS if n != "segment_code"]

DESCRIPTION_SQL = f"""
WITH f AS ({FEATURES_SQL}),
long AS (SELECT segment_code AS cluster, unnest({MEASURES!r}) AS feature,
                unnest([{", ".join(f'CAST("{n}" AS DOUBLE)' for n in MEASURES)}]) AS value FROM f),
q AS (SELECT segment_code AS cluster, quantile_cont(calls, 0.25) AS q1, median(calls) AS m, quantile_cont(calls, 0.75) AS q3 FROM f GROUP BY 1),
box AS (SELECT cluster, any_value(q1) AS q1, any_value(m) AS median, any_value(q3) AS q3, min(calls) AS whisker_low, max(calls) AS whisker_high
        FROM f JOIN q ON segment_code = cluster WHERE calls BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1),
years AS (SELECT segment_code AS cluster, CAST(first_year AS VARCHAR) AS level, count(*) AS n FROM f GROUP BY ALL),
described AS (
  SELECT 'box' AS part, cluster, unnest(['q1', 'median', 'q3', 'whisker_low', 'whisker_high']) AS name,
         unnest([q1, median, q3, whisker_low, whisker_high]) AS value FROM box
  UNION ALL SELECT 'scatter', segment_code, repairs || ', ' || stays, count(*) FROM f GROUP BY segment_code, repairs, stays
  UNION ALL SELECT 'profile', cluster, feature || ': Mean', avg(value) FROM long GROUP BY ALL
  UNION ALL SELECT 'profile', cluster, feature || ': Median', median(value) FROM long GROUP BY ALL
  UNION ALL SELECT 'nominal', cluster, level, n / sum(n) OVER (PARTITION BY cluster) FROM years
  UNION ALL SELECT 'counts_first_year', cluster, level, n FROM years
  UNION ALL SELECT 'histogram_mean_gap', cluster, CAST(CAST(floor(value / 30) * 30 AS BIGINT) AS VARCHAR), count(*)
            FROM long WHERE feature = 'mean_gap' GROUP BY cluster, floor(value / 30)
  UNION ALL SELECT 'histogram_rental_days', cluster, CAST(CAST(floor(value / 5) * 5 AS BIGINT) AS VARCHAR), count(*)
            FROM long WHERE feature = 'rental_days' GROUP BY cluster, floor(value / 5)
  UNION ALL SELECT 'sum_' || split_part(feature, ': ', 1), cluster, feature, sum(value) FROM long
            WHERE feature LIKE 'o_order%: %' AND value > 0 GROUP BY cluster, feature)
SELECT part, cluster, name, round(value, 4) AS value FROM described
"""


@query(DESCRIPTION_SQL)
def cluster_description(spark, folder):
    """Every table that describes clusters, stacked; the segments stand for the clusters here, so that SQL knows them."""
    rows = _features(spark, folder).withColumn("mean_gap", F.round("mean_gap", 6))
    rows = rows.withColumn(K.CLUSTER, F.col("segment_code").cast("bigint")).withColumn("first_year", F.col("first_year").cast("bigint"))
    rows = spark.read.parquet(S.write_table(rows, scratch_path(spark, "described")))
    pivots = {col: [n for n in MEASURES if n.startswith(f"{col}: ")] for col in ("o_orderstatus", "o_orderpriority")}
    tables = K.describe_clusters(
        rows, MEASURES, "calls", {"mean_gap": 30.0, "rental_days": 5.0}, ("repairs", "stays"), ["first_year"], pivots
    )
    bounds = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    box = tables["box"].select(K.CLUSTER, *[F.col(c).cast("double").alias(c) for c in bounds])
    level, start = F.col("first_year").cast("string"), F.col("bin_start").cast("bigint").cast("string")
    parts = {
        "box": A.unpivot(box, [K.CLUSTER], bounds, "name", "value"),
        "scatter": tables["scatter"].select(K.CLUSTER, F.concat_ws(", ", "repairs", "stays").alias("name"), F.col("n").alias("value")),
        "profile": tables["profile"].select(K.CLUSTER, F.concat_ws(": ", "feature", "kind").alias("name"), "value"),
        "nominal": tables["nominal"].select(K.CLUSTER, F.col("level").alias("name"), F.col("share").alias("value")),
        "counts_first_year": tables["counts_first_year"].select(K.CLUSTER, level.alias("name"), F.col("n").alias("value")),
    }
    for name in ("histogram_mean_gap", "histogram_rental_days"):
        parts[name] = tables[name].select(K.CLUSTER, start.alias("name"), F.col("n").alias("value"))
    for col in pivots:
        parts[f"sum_{col}"] = tables[f"sum_{col}"].select(K.CLUSTER, F.col(col).alias("name"), F.col("total").alias("value"))
    stacked = [
        df.select(F.lit(part).alias("part"), K.CLUSTER, "name", F.round(F.col("value").cast("double"), 4).alias("value"))
        for part, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, stacked)


@query()
def cluster_projection(spark, folder):
    """Customers on the first two components of the centred features."""
    frame, names = _kept_features(spark, folder)
    return K.project(frame, names).select("o_custkey", "pc1", "pc2")


def _document_features(spark, folder):
    """Labelled documents with simple attributes of the whole text, as a written table: fits pass over it several times."""
    # Counted before the labels are joined, so that no text is shuffled for them.
    documents = table(spark, folder, "documents").select(
        "doc_id",
        "lang",
        "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
    )
    features = documents.join(table(spark, folder, "labels"), "doc_id")
    features = features.select("doc_id", "quality", "lang", "source", "n_chars", "n_words", "n_lines")
    return spark.read.parquet(S.write_table(features, scratch_path(spark, "document-features")))


CATEGORIES, AMOUNTS = ["lang", "source"], ["n_chars", "n_words", "n_lines"]


_FORESTS: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def _forest(spark, folder):
    """The forest for document quality; searched for once per session and stored for those that follow."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FORESTS:
        train, test = C.hash_split(_document_features(spark, folder), "doc_id")
        found = C.fit_forest(train, "quality", CATEGORIES, AMOUNTS)
        _FORESTS[key] = S.save_model(found, scratch_path(spark, "forest")), test
    path, test = _FORESTS[key]
    return S.load_model(path), test


@query()
def rf_cv(spark, folder):
    """Random forest for document quality: scores of the test rows."""
    model, test = _forest(spark, folder)
    return C.score(model, test, "quality", ["doc_id"])


@query()
def gbt_cv(spark, folder):
    """Boosted trees for document quality: scores of the test rows."""
    train, test = C.hash_split(_document_features(spark, folder), "doc_id")
    model = C.fit_boosted(train, "quality", AMOUNTS)
    return C.score(model, test, "quality", ["doc_id"])


@query()
def importances(spark, folder):
    """What the forest for document quality looks at."""
    model, test = _forest(spark, folder)
    return C.importances(model, test, CATEGORIES, AMOUNTS)
