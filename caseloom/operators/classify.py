"""Splitting, preparing, fitting and judging classifiers with Spark ML."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext, StorageLevel, cloudpickle, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.clean import as_column
from caseloom.operators.aggregate import known_rows, unpivot
from caseloom.operators.boost import SETTINGS, boosted_accuracy
from caseloom.operators.forest import ForestGrower, GrownForest
from caseloom.operators.ordered import MAX_GROUP_ROWS, OrderedGroups
from caseloom.session import scratch_path

# Functions of this module travel to the executors whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABEL, FEATURES, PREDICTION, PROBABILITY = "_label", "_features", "prediction", "probability"

#: Rows per partition of a table that fits pass over.
FIT_ROWS = 200_000
#: A pass for a forest takes every row through all trees, so fewer rows make a partition, up to so many: each sends counts of all nodes.
FOREST_ROWS, FOREST_PARTS = 50_000, 3
#: Trees of a forest that are judged together.
TREES = 10

# Parameter grids searched by default.
FOREST_GRID = {"numTrees": [100, 200, 300, 500], "maxDepth": [3, 5, 7, 9, 12, 15]}
BOOST_GRID = {
    "maxIter": [100, 150],
    "stepSize": [0.1, 0.2],
    "maxDepth": [3, 5, 7],
    "subsamplingRate": [0.6, 0.8, 1.0],
    "featureSubsetStrategy": ["0.6", "0.8", "1.0"],
}


def split_share(key: Column | str, seed: int = 42) -> Column:
    """Number 0..99 that depends only on the key and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), as_column(key).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(100))


def hash_split(df: DataFrame, key: str, train_percent: int = 70, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; the split does not depend on partitioning."""
    share = split_share(key, seed)
    return df.filter(share < train_percent), df.filter(share >= train_percent)


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent known value of each text column, of equally frequent ones the smallest."""
    long = known_rows(unpivot(df, [], cols, "feature", "level"), ["level"])
    counts = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("mode"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def preparation(train: DataFrame, categories: Sequence[str], numbers: Sequence[str]) -> list:
    """Stages that fill, encode, scale and assemble columns; fill values come from ``train``.

    Missing categories become the most frequent one and are one-hot encoded, an unseen one
    as all zeros; missing numbers become the mean and are standardised.
    """
    fills = {r["feature"]: r["mode"] for r in modes(train, categories).collect()} if categories else {}
    stages: list = []
    if categories:
        filled = ", ".join(
            f"coalesce(`{c}`, {_sql_text(fills.get(c) or '')}) AS `_filled_{i}`" for i, c in enumerate(categories)
        )
        places = range(len(categories))
        stages += [
            SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
            StringIndexer(
                inputCols=[f"_filled_{i}" for i in places],
                outputCols=[f"_index_{i}" for i in places],
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            # The extra index for unseen values is the last one, which dropLast encodes as zeros.
            OneHotEncoder(inputCols=[f"_index_{i}" for i in places], outputCols=[f"_hot_{i}" for i in places], dropLast=True),
        ]
    if numbers:
        casts = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `_number_{i}`" for i, c in enumerate(numbers))
        places = range(len(numbers))
        stages += [
            SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"),
            Imputer(strategy="mean", inputCols=[f"_number_{i}" for i in places], outputCols=[f"_mean_{i}" for i in places]),
            VectorAssembler(inputCols=[f"_mean_{i}" for i in places], outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True),
        ]
    parts = [f"_hot_{i}" for i in range(len(categories))] + (["_scaled"] if numbers else [])
    stages.append(VectorAssembler(inputCols=parts, outputCol=FEATURES))
    return stages


def one_hot(df: DataFrame, train: DataFrame, categories: Sequence[str], out: str = "encoded") -> DataFrame:
    """Rows with their categories as a 0/1 array; levels are those of ``train``."""
    model = Pipeline(stages=preparation(train, categories, [])).fit(train)
    return model.transform(df).select(
        *[as_column(c) for c in df.columns], vector_to_array(FEATURES).alias(out)
    )


def standard_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Add each number, missing ones as the mean, in standard deviations from its mean."""
    model = Pipeline(stages=preparation(df, [], cols)).fit(df)
    scaled = model.transform(df).withColumn("_array", vector_to_array(FEATURES))
    return scaled.select(
        *[as_column(c) for c in df.columns], *[F.col("_array")[i].alias(f"{c}{suffix}") for i, c in enumerate(cols)]
    )


def some_trees(model, start: int, stop: int):
    """The ensemble of some of a fitted boosted model's trees, with their weights, as a JVM model."""
    java, context = model._java_obj, SparkContext.getOrCreate()
    of = context._jvm.org.apache.spark.ml

    def part(array, kind):
        found = context._gateway.new_array(kind, stop - start)
        context._jvm.java.lang.System.arraycopy(array, start, found, 0, stop - start)
        return found

    trees = part(java.trees(), of.regression.DecisionTreeRegressionModel)
    return of.classification.GBTClassificationModel(java.uid(), trees, part(java.treeWeights(), context._jvm.double))


def staged_accuracy(model, rows: DataFrame, stages: Sequence[int]) -> list[float]:
    """Share of ``rows`` that the first so many boosted trees call right, for all stages in one pass.

    What trees say adds up, so each tree is asked once: the trees between two stages speak
    together, and a stage is the sum of those before it. Labels are 0 and 1.
    """
    votes, right, start = F.lit(0.0), {}, 0
    for n in sorted(stages):
        part = some_trees(model, start, n)
        part.setFeaturesCol(FEATURES)
        part.setRawPredictionCol(f"_raw_{n}")
        part.setProbabilityCol("")
        part.setPredictionCol("")
        rows = DataFrame(part.transform(rows._jdf), rows.sparkSession)
        raw = vector_to_array(f"_raw_{n}")
        votes, start = votes + raw[1] - raw[0], n
        right[n] = F.avg(((votes > 0) == (F.col(LABEL) == 1)).cast("double")).alias(f"right_{n}")
    return [value or 0.0 for value in rows.agg(*[right[n] for n in stages]).first()]


NODE = "tree int, id int, left int, right int, feature int, threshold double, prediction double, vote double"


def _nodes(model, spark) -> DataFrame:
    """``NODE`` of a forest's trees, ids from the root on; ``vote`` is the positive share of the rows at a node less the negative one."""
    if isinstance(model, GrownForest):
        path = model.path
    else:
        path = scratch_path(spark, "forest")
        model.write().save(path)
    node, split = "nodeData", "nodeData.split"
    positive, negative = (F.coalesce(F.get(f"{node}.impurityStats", F.lit(i)), F.lit(0.0)) for i in (1, 0))
    value, kinds = F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0)), F.col(f"{split}.numCategories")
    # Categories are 0 and 1 here, so a split by them is one at a half; its sides change places if 1 goes left.
    turned = (kinds != -1) & (value == 1)
    left, right = F.col(f"{node}.leftChild"), F.col(f"{node}.rightChild")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), f"{node}.id", F.when(turned, right).otherwise(left).alias("left"),
        F.when(turned, left).otherwise(right).alias("right"), F.col(f"{split}.featureIndex").alias("feature"),
        F.when(kinds == -1, value).otherwise(0.5).alias("threshold"), f"{node}.prediction",
        F.coalesce(F.try_divide(positive - negative, positive + negative), F.lit(0.0)).alias("vote"),
    )


def cut_votes(nodes: pd.DataFrame, depths: Sequence[int]) -> tuple[np.ndarray, ...]:
    """Roots, features, thresholds, sides of trees, and per depth what each node says if the trees end there.

    ``nodes`` (``NODE``) are whole trees. As in fitting, a node whose leaves all predict the same is a leaf itself.
    """
    nodes = nodes.sort_values(["tree", "id"])
    ids, inner = nodes["id"].to_numpy(np.int64), nodes["left"].to_numpy() >= 0
    here = np.arange(len(nodes))
    sides = [np.where(inner, here - ids + nodes[side].to_numpy(), here) for side in ("left", "right")]
    roots = np.flatnonzero(ids == 0)
    level, levels = roots, []
    while len(level := level[inner[level]]):
        levels.append(level)
        level = np.concatenate([side[level] for side in sides])
    said, votes = nodes["prediction"].to_numpy(), nodes["vote"].to_numpy()
    found = np.empty((len(depths), len(nodes)))
    for place, depth in enumerate(depths):
        alike, speaks = np.ones(len(nodes), bool), here.copy()
        for of in reversed(levels[:depth]):
            left, right = (side[of] for side in sides)
            alike[of] = alike[left] & alike[right] & (said[left] == said[right])
        for of in levels[:depth]:
            for side in sides:
                speaks[side[of]] = np.where(alike[of], speaks[of], side[of])
        found[place] = votes[speaks]
    return roots, np.maximum(nodes["feature"].to_numpy(np.int64), 0), nodes["threshold"].fillna(0.0).to_numpy(), *sides, found


def forest_accuracy(model, rows: DataFrame, sizes: Sequence[int], depths: Sequence[int]) -> list[list[float]]:
    """Share of ``rows`` that forests of the first so many trees, cut at a depth, call right; a list of sizes per depth.

    A tree grown to a depth is the upper part of one grown further: nodes are split level by level, with
    the same draws. Blocks of rows meet groups of trees, so no task has all of either. Labels are 0 and 1.
    """
    spark = rows.sparkSession
    ends = sorted(sizes)
    # Trees of one group are counted in the same sizes.
    part = sum((F.col("tree") >= n).cast("int") for n in ends)
    groups = _nodes(model, spark).withColumn("part", part).filter(F.col("part") < len(ends))
    groups = groups.withColumn("_group", F.struct("part", F.floor(F.col("tree") / TREES).alias("number")))
    many = len(ends) - 1 + -(-ends[-1] // TREES)

    def pack(nodes: pd.DataFrame) -> pd.DataFrame:
        arrays = cut_votes(nodes, depths)
        return pd.DataFrame([(nodes["part"].iloc[0], *(np.ascontiguousarray(of).tobytes() for of in arrays))])

    names = ["roots", "feature", "threshold", "left", "right", "votes"]
    trees = groups.groupBy("_group").applyInPandas(pack, "part int, " + ", ".join(f"{n} binary" for n in names)).repartition(many)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # A feature's values lie side by side.
                values, labels = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1).T, batch["label"].to_numpy()
                columns = [pa.array([len(labels)], pa.int32()), *(pa.array([of.astype(float).tobytes()], pa.binary()) for of in (values, labels))]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "x", "label"])

    blocks = rows.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).alias("label")).mapInArrow(block, "n int, x binary, label binary")
    # Written, so that they are not made anew for each group of trees that they meet.
    path = scratch_path(spark, "judged")
    blocks.withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    blocks = spark.read.parquet(path)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, n, each = np.frombuffer(row["x"]), row["n"], np.arange(row["n"])
                roots, feature, left, right = (np.frombuffer(row[n], np.int64) for n in ("roots", "feature", "left", "right"))
                threshold, votes = np.frombuffer(row["threshold"]), np.frombuffer(row["votes"]).reshape(len(depths), -1)
                total, begins, sides = np.zeros((len(depths), n)), feature * n, np.stack([left, right], axis=1).ravel()
                for root in roots:
                    at = np.full(n, root)
                    for depth in range(max(depths) + 1):
                        for place in np.flatnonzero(np.equal(depths, depth)):
                            total[place] += votes[place].take(at)
                        at = sides.take(2 * at + ~(x.take(begins.take(at) + each) <= threshold.take(at)))
                columns = [[row["block"]], [row["part"]], [row["label"]], [total.tobytes()]]
                types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "part", "label", "votes"])

    spoken = trees.crossJoin(blocks).mapInArrow(walk, "block long, part int, label binary, votes binary")

    def judge(said: pd.DataFrame) -> pd.DataFrame:
        label = np.frombuffer(said["label"].iloc[0]) == 1
        votes = np.zeros((len(ends), len(depths), len(label)))
        for at, of in zip(said["part"], said["votes"]):
            votes[at] += np.frombuffer(of).reshape(len(depths), -1)
        right = ((np.cumsum(votes, axis=0) > 0) == label).sum(axis=2)
        return pd.DataFrame([(len(label), right.T.ravel().tolist())])

    judged = spoken.groupBy("block").applyInPandas(judge, "n long, right array<bigint>")
    cells = range(len(ends) * len(depths))
    n, *right = judged.agg(F.sum("n"), *[F.sum(F.get("right", F.lit(cell))) for cell in cells]).first()
    shares = [value / n if n else 0.0 for value in right]
    return [[shares[place * len(ends) + ends.index(size)] for size in sizes] for place in range(len(depths))]


def _search(
    train, stages, make: Callable, size: str, grid: Mapping[str, Sequence], folds: int, parallelism: int, seed: int, depth: str | None = None,
    together: Callable | None = None,
):
    """Cross-validated search in which one ensemble serves all settings that differ in its size only.

    ``size`` names the parameter that counts trees. An ensemble of the most trees is fitted per
    fold and combination of the others, and its first trees are judged for every size. If trees do not depend on one another,
    ``depth`` names the parameter that limits their depth: the deepest are fitted, and judged cut at every depth.
    ``together`` (rows, settings, sizes) judges all settings and folds at once instead.
    """
    # The preparation does not depend on the grid: fit it once, search the classifier only.
    prepared = Pipeline(stages=stages).fit(train)
    path = scratch_path(train.sparkSession, "search")
    # Folds are drawn once and written. Fits pass over the rows very often, so these lie in as few partitions as hold them well.
    found = prepared.transform(train).select(FEATURES, LABEL).withColumn("_fold", F.floor(F.rand(seed) * folds).cast("int"))
    found.write.parquet(path)
    rows = train.sparkSession.read.parquet(path)
    many = rows.count()
    parts = max(1, -(-many // FIT_ROWS), min(FOREST_PARTS, -(-many // FOREST_ROWS)) if depth in grid else 1)
    rows = rows.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = list(grid[size])
    others = [name for name in grid if name != size]
    settings = [dict(zip(others, values)) for values in itertools.product(*(grid[name] for name in others))]
    # The settings that one fit serves.
    served: dict[tuple, list[int]] = {}
    for at, setting in enumerate(settings):
        served.setdefault(tuple(value for name, value in setting.items() if name != depth), []).append(at)

    @inheritable_thread_target(train.sparkSession)
    def judge(job):
        fold, group = job
        largest = settings[max(group, key=lambda at: settings[at].get(depth, 0))]
        fitted = make(**largest, **{size: max(sizes)}).fit(rows.filter(F.col("_fold") != fold))
        held = rows.filter(F.col("_fold") == fold)
        if depth in others:
            return forest_accuracy(fitted, held, sizes, [settings[at][depth] for at in group])
        return [staged_accuracy(fitted, held, sizes)]

    try:
        if together:
            scores = together(rows, settings, sizes)
        else:
            jobs = [(fold, group) for group in served.values() for fold in range(folds)]
            # Deep ensembles take longest; started first, they do not run on alone at the end.
            jobs.sort(key=lambda job: -settings[job[1][0]].get("maxDepth", 0))
            with ThreadPoolExecutor(parallelism) as pool:
                results = list(pool.map(judge, jobs))
            scores = {(at, fold): score for (fold, group), found in zip(jobs, results) for at, score in zip(group, found)}
        means = {
            (at, n): sum(scores[at, fold][place] for fold in range(folds)) / folds
            for at in range(len(settings))
            for place, n in enumerate(sizes)
        }
        # Of equally good settings the first in the order of the grid.
        at, n = max(means, key=lambda key: (means[key], -key[0], -sizes.index(key[1])))
        best = make(**settings[at], **{size: n}).fit(rows)
    finally:
        rows.unpersist()
    if isinstance(best, GrownForest):
        best = best.loaded(train.sparkSession)
    return PipelineModel(stages=[*prepared.stages, best])


def with_label(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is known, with it as a number."""
    return known_rows(df, [label]).withColumn(LABEL, as_column(label).cast("double"))


def fit_forest(
    train: DataFrame,
    label: str,
    categories: Sequence[str],
    numbers: Sequence[str],
    grid: Mapping[str, Sequence] | None = None,
    folds: int = 5,
    parallelism: int = 8,
    seed: int = 42,
) -> PipelineModel:
    """Random forest chosen by cross-validated accuracy over a grid.

    The first trees of a forest are a forest of their number, drawn like one fitted by itself, and the
    upper levels of a tree are one of less depth, so one fit per fold serves all numbers of trees and depths.
    """
    grid = grid or FOREST_GRID
    # Without a choice of depths Spark ML's own.
    grid = {**grid, "maxDepth": grid.get("maxDepth", [5])}
    rows = with_label(train, label)
    # If Spark ML fits, each row keeps its node, so tasks do not get all trees grown so far with every level.
    make = lambda **setting: ForestGrower(
        labelCol=LABEL, featuresCol=FEATURES, seed=seed, cacheNodeIds=True, maxMemoryInMB=1024, **setting
    )
    return _search(rows, preparation(rows, categories, numbers), make, "numTrees", grid, folds, parallelism, seed, "maxDepth")


def fit_boosted(
    train: DataFrame,
    label: str,
    numbers: Sequence[str],
    grid: Mapping[str, Sequence] | None = None,
    folds: int = 5,
    parallelism: int = 8,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees chosen by cross-validated accuracy over a grid.

    Boosting adds tree after tree, so the first trees of a long run are those of a shorter one, and one
    run per fold and setting serves all numbers of steps. Settings are judged by runs grown side by side, unless
    the grid has parameters that these do not know; the chosen one is fitted by Spark ML.
    """
    grid = grid or BOOST_GRID
    make = lambda **setting: GBTClassifier(labelCol=LABEL, featuresCol=FEATURES, seed=seed, **setting)
    assembler = VectorAssembler(inputCols=list(numbers), outputCol=FEATURES)
    known = set(grid) - {"maxIter"} <= set(SETTINGS)
    together = lambda rows, settings, sizes: boosted_accuracy(rows, FEATURES, LABEL, settings, sizes, folds, seed)
    return _search(
        with_label(train, label), [assembler], make, "maxIter", grid, folds, parallelism, seed, None, together if known else None
    )


def score(model: PipelineModel, df: DataFrame, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Label, prediction and probability of the positive class."""
    scored = model.transform(with_label(df, label))
    return scored.select(
        *[as_column(k) for k in keep],
        F.col(LABEL).cast("int").alias("label"),
        F.col(PREDICTION).cast("int").alias("prediction"),
        vector_to_array(PROBABILITY)[1].alias("score"),
    )


def _ranked(df: DataFrame, score_col: str, label: str, max_group_rows: int) -> DataFrame:
    """Per score, from the highest: positives and negatives at it, and down to it."""
    positive = as_column(label).cast("int")
    counts = (
        known_rows(df, [score_col, label])
        .groupBy(as_column(score_col).alias("threshold"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    )
    scan = OrderedGroups(counts, [], ["threshold"], descending=True, max_group_rows=max_group_rows)
    return scan.running_sum("tp", "pos").running_sum("fp", "neg").result()


def roc_curve(df: DataFrame, score_col: str, label: str, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """False and true positive rate at each score as threshold."""
    ranked = _ranked(df, score_col, label, max_group_rows)
    totals = ranked.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).scalar()
    return ranked.select(
        "threshold",
        F.try_divide(F.col("fp"), totals["neg"]).alias("fpr"),
        F.try_divide(F.col("tp"), totals["pos"]).alias("tpr"),
    )


def roc_auc(df: DataFrame, score_col: str, label: str, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule, one row."""
    ranked = _ranked(df, score_col, label, max_group_rows)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return ranked.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per label and prediction."""
    return (
        known_rows(df, [label, prediction])
        .groupBy(as_column(label).alias("label"), as_column(prediction).alias("prediction"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class: precision, recall, F1 and support."""
    cells = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    # Each cell counts once for its label and once for its prediction.
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"), hit.cast("bigint").alias("hits")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hits")])
    # A class never predicted or never present scores zero.
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("called")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("called") + F.col("support")), F.lit(0.0))
    return per_class.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def feature_names(
    model: PipelineModel, df: DataFrame, categories: Sequence[str] = (), numbers: Sequence[str] = ()
) -> list[str]:
    """Names behind the positions of the feature vector, ``category=level`` or the number."""
    groups = model.transform(df).schema[FEATURES].metadata["ml_attr"]["attrs"].values()
    names = {}
    for attribute in (a for group in groups for a in group):
        name = attribute["name"]
        if name.startswith("_hot_"):
            place, level = name.removeprefix("_hot_").split("_", 1)
            name = f"{categories[int(place)]}={level}"
        elif name.startswith("_scaled_"):
            name = numbers[int(name.removeprefix("_scaled_"))]
        names[attribute["idx"]] = name
    return [names[i] for i in sorted(names)]


def importances(
    model: PipelineModel, df: DataFrame, categories: Sequence[str] = (), numbers: Sequence[str] = ()
) -> DataFrame:
    """Importance of each feature by name, most important first."""
    values = model.stages[-1].featureImportances.toArray()
    names = feature_names(model, df, categories, numbers)
    rows = list(zip(names, map(float, values), strict=True))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )
