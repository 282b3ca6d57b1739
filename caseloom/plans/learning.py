"""The learning stage: features per vehicle, clusters, and two classifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import to_flag
from caseloom.functions.clean import as_column
from caseloom.operators import classify as C
from caseloom.operators import cluster as K
from caseloom.operators.skew import spread_join
from caseloom.operators.features import any_per_entity, encode_labels, entity_features, label_codes
from caseloom.plans.names import SERVICES

ENTITY = "VIN"
PIVOTED = ("Outcome Description", "Component")

# Fixed value: what a missing model line is called.
UNKNOWN_MODEL = "Nicht definiert"

# Feature names, and columns that already take part in the score.
FEATURE_NAMES = {
    "calls": "Anzahl_Anrufe",
    "gap": "Durschnittliche_Zeit_zwischen_Towings",
    "services": "Total Services Offered",
    "since_year": "Registration Date Jahr",
    "repairs": "Repairs",
    "stays": "Aufenthalte",
}
IN_SCORE = (
    "Total Services Offered",
    "Anzahl_Anrufe",
    "Rental_Car_Days",
    "Outcome Description: Towing",
    "Outcome Description: Scheduled Towing",
)
MERGED_CATEGORIES = ("Country Of Incident", "Handling Call Center", "Baureihe", "Component")
MERGED_NUMBERS = ("Anzahl Q-Line",)


def model_codes(calls: DataFrame) -> DataFrame:
    """Numbers of the model lines, ``label, code``: part of what a fitted model relies on."""
    return label_codes(calls.select(F.coalesce("Modellreihe", F.lit(UNKNOWN_MODEL)).alias("line")), "line")


def vehicle_features(
    calls: DataFrame,
    repairs: DataFrame,
    pivots: Mapping[str, Sequence[str] | None] | None = None,
    suspect: str = "first",
    codes: DataFrame | None = None,
) -> DataFrame:
    """One row of numbers per vehicle, with its label ``Suspect``.

    ``codes`` are the :func:`model_codes` that a model was fitted with; without them, those of ``calls``.

    The label is that of the call with the earliest registration date, or with
    ``suspect="any"`` whether any call is suspect.
    """
    codes = model_codes(calls) if codes is None else codes
    coded = encode_labels(calls, "Modellreihe", "Modellreihe_Encoded", codes, UNKNOWN_MODEL)
    coded = coded.withColumns({c: to_flag(c) for c in ("Telephone Help", "Service Paid By Customer")})
    order = ["Incident Date", "Case Number"]
    features = entity_features(
        coded,
        repairs,
        ENTITY,
        "Incident Date",
        "days_since_last_towing",
        {
            "Telephone Help": "Telephone_Help",
            "Service Paid By Customer": "Service_Paid_By_Customer",
            "Rental Car Days": "Rental_Car_Days",
        },
        SERVICES,
        "Registration Date",
        {"Modellreihe_Encoded": "Modellreihe_Encoded", "Modellreihe": "Modellreihe", "Suspect": "Suspect"},
        pivots or dict.fromkeys(PIVOTED),
        "Q-Line",
        "Werkstattaufenthalt",
        order,
        FEATURE_NAMES,
    )
    if suspect == "any":
        features = features.drop("Suspect").join(any_per_entity(calls, ENTITY, "Suspect", "Suspect"), ENTITY, "left")
    return features


def numeric_features(features: DataFrame) -> list[str]:
    """Feature columns: all numbers but the vehicle, its model name and the label."""
    apart = (ENTITY, "Modellreihe", "Suspect", K.CLUSTER)
    return [f.name for f in features.schema.fields if f.name not in apart and not isinstance(f.dataType, VectorUDT)]


def align(features: DataFrame, known: Sequence[str]) -> DataFrame:
    """The feature columns a model was fitted on, in its order; absent ones are zero, others go."""
    present = numeric_features(features)
    kept = [as_column(c) for c in features.columns if c not in present]
    return features.select(*kept, *[as_column(k) if k in present else F.lit(0.0).alias(k) for k in known])


def safe_names(features: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Features under names Spark ML accepts: the frame, those names, and what they stand for."""
    meant = numeric_features(features)
    plain = [f"f{i}" for i in range(len(meant))]
    kept = [as_column(c) for c in features.columns if c not in meant]
    return features.select(*kept, *[as_column(m).cast("double").alias(p) for m, p in zip(meant, plain)]), plain, meant


def cluster_vehicles(features: DataFrame) -> K.Clustering:
    """Clusters of vehicles by their features."""
    frame, plain, _ = safe_names(features)
    return K.fit_clusters(frame, plain)


def with_clusters(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Features with the cluster of each vehicle."""
    frame, plain, meant = safe_names(features)
    predicted = K.predict_clusters(model, frame)
    kept = [as_column(c) for c in predicted.columns if c not in plain]
    return predicted.select(*kept, *[as_column(p).alias(m) for m, p in zip(meant, plain)])


def vehicle_silhouettes(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Cluster and silhouette of each vehicle, by the components that the clusters were found with."""
    frame, _, _ = safe_names(features)
    placed = K.predict_clusters(model, frame, keep_components=True)
    return K.sample_silhouette(placed.select(ENTITY, K.CLUSTER, K.COMPONENTS), K.COMPONENTS, K.CLUSTER).drop(K.COMPONENTS)


def describe(clustered: DataFrame) -> dict[str, DataFrame]:
    """The tables that describe the clusters."""
    meant = numeric_features(clustered)
    pivots = {p: [c for c in meant if c.startswith(f"{p}: ")] for p in PIVOTED}
    towed = "Durschnittliche_Zeit_zwischen_Towings"
    rows = clustered.withColumn(f"{towed} > 0", F.when(as_column(towed) > 0, as_column(towed)))
    frame, plain, _ = safe_names(clustered)
    tables = K.describe_clusters(
        rows,
        meant,
        "Anzahl_Anrufe",
        {f"{towed} > 0": 30.0, "Rental_Car_Days": 5.0},
        ("Repairs", "Aufenthalte"),
        ["Modellreihe"],
        {name: cols for name, cols in pivots.items() if cols},
    )
    tables["projection"] = K.project(frame, plain).select(ENTITY, K.CLUSTER, "pc1", "pc2")
    return tables


def fit_suspects(features: DataFrame, grid: Mapping[str, Sequence] | None = None, folds: int = 5) -> PipelineModel:
    """Boosted trees for ``Suspect`` on features that are no part of the score."""
    frame, plain, meant = safe_names(features)
    usable = [p for p, m in zip(plain, meant) if m not in IN_SCORE]
    train, _ = C.hash_split(frame, ENTITY)
    return C.fit_boosted(train, "Suspect", usable, grid, folds)


def with_repair_count(calls: DataFrame, repairs: DataFrame) -> DataFrame:
    """Calls with the number of repair lines of their vehicle."""
    counts = repairs.groupBy(ENTITY).agg(F.count(as_column("Q-Line")).alias("Anzahl Q-Line"))
    return spread_join(calls, counts, [ENTITY]).fillna(0, subset=["Anzahl Q-Line"])


def fit_merged(
    calls: DataFrame, repairs: DataFrame, grid: Mapping[str, Sequence] | None = None, folds: int = 5
) -> PipelineModel:
    """Random forest for ``Merged`` on attributes of the call and the vehicle's repairs."""
    train, _ = C.hash_split(with_repair_count(calls, repairs), "Case Number")
    return C.fit_forest(train, "Merged", MERGED_CATEGORIES, MERGED_NUMBERS, grid, folds)


def judge(scored: DataFrame) -> dict[str, DataFrame]:
    """ROC curve, its area, confusion counts and the per-class report of scored test rows."""
    return {
        "roc": C.roc_curve(scored, "score", "label"),
        "auc": C.roc_auc(scored, "score", "label"),
        "confusion": C.confusion(scored, "label", "prediction"),
        "report": C.classification_report(scored, "label", "prediction"),
    }
