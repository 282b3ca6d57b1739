"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, UnivariateFeatureSelector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.tables import keep

#: Labelled rows per class that the model is fitted on at most.
MAX_ROWS = 10_000
#: Hash buckets of the terms, and how many of them the machine sees: those that depend most on the label.
BUCKETS, FEATURES = 1 << 18, 2048
#: Length of the word beginnings that are terms beside the words, for inflected and compound words.
STEM = 4
#: Latent factors per term, steps and step size of the fit.
FACTORS, STEPS, STEP, PENALTY = 4, 100, 0.1, 1e-3


def terms(text: Column) -> Column:
    """Lower-cased words of a text and their beginnings. Null is like empty."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))
    return F.concat(words, F.array_distinct(F.transform(words, lambda word: F.concat(F.lit("^"), F.substring(word, 1, STEM)))))


def fit(labelled: DataFrame) -> PipelineModel | float:
    """Fits on ``labelled`` (terms, label 0.0 or 1.0); with less than two classes, the share of ones.

    Terms are hashed, the buckets that depend most on the label by a chi-square test are kept, and
    the machine learns a weight and a latent vector for each, so a pair of terms counts by the
    product of their vectors beside what each counts alone.
    """
    ones, rows = labelled.agg(F.sum("label"), F.count("label")).first()
    if not ones or ones == rows:
        return ones / rows if rows else 0.0
    hashed = HashingTF(inputCol="terms", outputCol="hashed", numFeatures=BUCKETS, binary=True)
    chosen = UnivariateFeatureSelector(featuresCol="hashed", labelCol="label", outputCol="features", selectionMode="numTopFeatures")
    chosen.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(FEATURES)
    machine = FMClassifier(factorSize=FACTORS, maxIter=STEPS, stepSize=STEP, regParam=PENALTY, initStd=0.01, seed=5, tol=1e-9)
    first = Pipeline(stages=[hashed, chosen]).fit(labelled)
    seen = keep(first.transform(labelled).select("features", "label"), "toxicity-features")
    return PipelineModel(stages=[*first.stages, machine.fit(seen)])


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(terms, label) of at most ``max_rows`` labelled documents per class, chosen by a hash of the id.

    ``labels`` has doc_id and label; of several labels of a document the largest counts. Rows
    without an id, a label or a document take no part.
    """
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = keep(known, "toxicity-labels")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("label") == of).orderBy(*order).limit(max_rows) for of in (0, 1)]
    chosen = keep(chosen[0].unionByName(chosen[1]), "toxicity-chosen")
    # At most 2 * max_rows rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return keep(rows.select(terms(F.col("text")).alias("terms"), F.col("label").cast("double").alias("label")), "toxicity-sample")


def score(docs: DataFrame, model: PipelineModel | float) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (doc_id, text): the probability of label 1.

    Null and empty texts get the score of a text without terms. Repeated rows get equal scores.
    Without anything to learn from, the score is the share of ones among the labels, else 0.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", terms(F.col("text")).alias("terms"))
    if isinstance(model, float):
        return rows.select("doc_id", F.lit(model).alias("score"))
    return model.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("score"))
