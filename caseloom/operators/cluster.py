"""Scaling, principal components, k-means and silhouettes.

Data stays in DataFrames; what is collected are fitted parameters: variance ratios,
loadings, cluster centres and per-cluster sums, all sized by features times clusters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, MaxAbsScaler, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.clean import as_column
from caseloom.operators.aggregate import (
    histogram,
    known_rows,
    melt_sum,
    profile_groups,
    profile_nominal,
    top_n_abs,
    value_counts,
)
from caseloom.operators.quantiles import box_stats

FEATURES, SCALED, ALL_COMPONENTS, COMPONENTS, CLUSTER = "_features", "_scaled", "_all_components", "_components", "cluster"
KS = range(2, 8)


def assemble(df: DataFrame, cols: Sequence[str], out: str = FEATURES) -> DataFrame:
    """Number columns as one vector."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def max_abs_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Add each number divided by its column's largest absolute value."""
    assembled = assemble(df, cols)
    scaled = MaxAbsScaler(inputCol=FEATURES, outputCol=SCALED).fit(assembled).transform(assembled)
    values = vector_to_array(SCALED)
    return scaled.select(*[as_column(c) for c in df.columns], *[values[i].alias(f"{c}{suffix}") for i, c in enumerate(cols)])


def _fit_components(df: DataFrame, cols: Sequence[str]) -> PipelineModel:
    """Scaling and all components, fitted in one go."""
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol=FEATURES),
        MaxAbsScaler(inputCol=FEATURES, outputCol=SCALED),
        PCA(k=len(cols), inputCol=SCALED, outputCol=ALL_COMPONENTS),
    ]
    return Pipeline(stages=stages).fit(df)


def _pca_of(model: PipelineModel):
    return next(stage for stage in model.stages if hasattr(stage, "explainedVariance"))


def _variance_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    rows, total = [], 0.0
    for i, share in enumerate(_pca_of(model).explainedVariance.toArray(), 1):
        total += float(share)
        rows.append((i, float(share), total))
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


def pca_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of variance per component of the max-abs scaled columns, and its running sum."""
    return _variance_table(_fit_components(df, cols), df)


def components_for(variance: DataFrame, share: float = 0.8) -> int:
    """Smallest number of components that explains the share of variance."""
    reached = variance.filter(F.col("cumulative") >= share).agg(F.min("component")).first()[0]
    return int(reached or variance.count())


def pca_loadings(model: PipelineModel, cols: Sequence[str], df: DataFrame, size: int | None = None) -> DataFrame:
    """Weight of each feature in the first ``size`` components: ``component, feature, loading``."""
    weights = _pca_of(model).pc.toArray()[:, :size]
    rows = [
        (f"PC{j}", feature, float(weights[i, j])) for i, feature in enumerate(cols) for j in range(weights.shape[1])
    ]
    return df.sparkSession.createDataFrame(rows, "component string, feature string, loading double")


def top_loadings(loadings: DataFrame, n: int = 5) -> DataFrame:
    """The features that weigh most in each component."""
    return top_n_abs(loadings, "component", "loading", n, "feature")


def project(df: DataFrame, cols: Sequence[str], k: int = 2, out: str = "pc") -> DataFrame:
    """Coordinates on the first components of the centred columns, ``pc1``, ``pc2`` ..."""
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol=FEATURES),
        StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True, withStd=False),
        PCA(k=k, inputCol=SCALED, outputCol=COMPONENTS),
    ]
    placed = Pipeline(stages=stages).fit(df).transform(df)
    coordinates = vector_to_array(COMPONENTS)
    return placed.select(*[as_column(c) for c in df.columns], *[coordinates[i].alias(f"{out}{i + 1}") for i in range(k)])


def _squared_norm(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sample_silhouette(df: DataFrame, features: str, cluster: str, out: str = "silhouette") -> DataFrame:
    """Silhouette of every row by squared Euclidean distance.

    The mean distance from a row to a cluster follows from the cluster's size, vector sum
    and sum of squared norms, so rows meet a few sums and never each other.
    """
    norms = df.withColumn("_point", vector_to_array(features)).withColumn("_norm2", _squared_norm(F.col("_point")))
    sums = (
        known_rows(norms, [cluster])
        .groupBy(as_column(cluster).alias("cluster"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            vector_to_array(Summarizer.sum(F.col(features))).alias("total"),
            F.sum("_norm2").alias("norm2"),
        )
    )
    # One entry per cluster.
    clusters = sums.agg(F.collect_list(F.struct("cluster", "n", "total", "norm2"))).scalar()

    def mean(c: Column) -> Column:
        return F.col("_norm2") + c["norm2"] / c["n"] - F.lit(2.0) / c["n"] * _dot(F.col("_point"), c["total"])

    distances = F.transform("_clusters", lambda c: F.struct(c["cluster"].alias("cluster"), c["n"].alias("n"), mean(c).alias("mean")))
    here = F.get(F.filter("_distances", lambda d: d["cluster"] == as_column(cluster)), F.lit(0))
    others = F.filter("_distances", lambda d: d["cluster"] != as_column(cluster))
    # The row itself is no neighbour; a cluster of one has none.
    own = F.when(here["n"] > 1, here["mean"] * (here["n"] / (here["n"] - 1)))
    near = F.array_min(F.transform(others, lambda d: d["mean"]))
    spread = F.greatest(F.col("_own"), F.col("_near"))
    scored = norms.withColumn("_clusters", clusters).withColumn("_distances", distances).withColumns({"_own": own, "_near": near})
    value = F.coalesce(F.try_divide(F.col("_near") - F.col("_own"), spread), F.lit(0.0))
    alone = F.col("_own").isNull() | F.col("_near").isNull()
    return scored.select(*[as_column(c) for c in df.columns], F.when(alone, 0.0).otherwise(value).alias(out))


@dataclass(frozen=True)
class Clustering:
    """A fitted clustering with the tables that led to it."""

    model: PipelineModel
    variance: DataFrame
    loadings: DataFrame
    silhouettes: DataFrame
    k: int


def silhouette_by_k(projected: DataFrame, ks: Sequence[int] = KS, seed: int = 42) -> DataFrame:
    """Mean silhouette of a k-means fit for each number of clusters."""
    judge = ClusteringEvaluator(featuresCol=COMPONENTS, predictionCol=CLUSTER, metricName="silhouette")
    rows = []
    for k in ks:
        fit = KMeans(k=k, seed=seed, featuresCol=COMPONENTS, predictionCol=CLUSTER).fit(projected)
        rows.append((k, float(judge.evaluate(fit.transform(projected)))))
    return projected.sparkSession.createDataFrame(rows, "k int, silhouette double")


def fit_clusters(
    df: DataFrame, cols: Sequence[str], share: float = 0.8, ks: Sequence[int] = KS, seed: int = 42
) -> Clustering:
    """Scale, keep the components for ``share`` of the variance, pick k by silhouette, fit."""
    fitted = _fit_components(df, cols)
    variance = _variance_table(fitted, df)
    size = components_for(variance, share)
    # The first components do not depend on how many are kept, so no second fit is needed.
    keep = VectorSlicer(inputCol=ALL_COMPONENTS, outputCol=COMPONENTS, indices=list(range(size)))
    prepared = PipelineModel(stages=[*fitted.stages, keep])
    # Every fit and score below passes over this again.
    projected = prepared.transform(df).select(COMPONENTS).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        silhouettes = silhouette_by_k(projected, ks, seed)
        best = silhouettes.orderBy(F.col("silhouette").desc(), "k").first()["k"]
        means = KMeans(k=best, seed=seed, featuresCol=COMPONENTS, predictionCol=CLUSTER).fit(projected)
    finally:
        projected.unpersist()
    model = PipelineModel(stages=[*prepared.stages, means])
    return Clustering(model, variance, pca_loadings(prepared, cols, df, size), silhouettes, best)


def predict_clusters(model: PipelineModel, df: DataFrame, keep_components: bool = False) -> DataFrame:
    """Rows with their cluster."""
    scored = model.transform(df)
    return scored.drop(FEATURES, SCALED, ALL_COMPONENTS, *([] if keep_components else [COMPONENTS]))


def describe_clusters(
    df: DataFrame,
    numbers: Sequence[str],
    box: str,
    histograms: dict[str, float],
    scatter: tuple[str, str],
    nominal: Sequence[str],
    pivots: dict[str, Sequence[str]],
    cluster: str = CLUSTER,
) -> dict[str, DataFrame]:
    """The tables that describe clusters, by name."""
    tables = {
        "projection": project(df, numbers),
        "box": box_stats(df, box, [cluster]),
        "scatter": value_counts(df, [cluster, *scatter]),
        "profile": profile_groups(df, cluster, numbers),
        "nominal": profile_nominal(df, cluster, nominal),
    }
    for col, step in histograms.items():
        tables[f"histogram_{col}"] = histogram(df, col, step=step, by=[cluster])
    for col in nominal:
        tables[f"counts_{col}"] = value_counts(df, [cluster, col])
    for name, cols in pivots.items():
        tables[f"sum_{name}"] = melt_sum(df, [cluster], cols, name, "total")
    return tables
