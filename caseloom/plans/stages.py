"""The three stages end to end, with Parquet tables between them.

Every stage reads what an earlier one wrote, so a lost executor costs a stage at most and
no plan grows over several stages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import parse_date
from caseloom.operators import aggregate as A
from caseloom.operators import classify as C
from caseloom.operators import cluster
from caseloom.plans import cases, learning, reports
from caseloom.plans import names as N
from caseloom.session import tune
from caseloom.sources import load_model, read_harmonised, read_table, save_model, write_table
from caseloom.sources.tables import SOURCE_ORDER

STAGES = ("data_preparation", "analysis", "machine_learning")
YEARS = ("2021", "2022", "2023")


class Folder:
    """Tables below one path, in the session's compression or the given one."""

    def __init__(self, spark: SparkSession, path: str, compression: str | None = None):
        self.spark, self.path, self.compression = spark, path.rstrip("/"), compression

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table and return it as read back."""
        write_table(df, f"{self.path}/{name}", compression=self.compression)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def run_preparation(spark: SparkSession, input_dir: str, output_dir: str, fmt: str = "csv") -> None:
    """Clean calls, build cases and stays, link them, score the calls."""
    interim, output = Folder(spark, f"{output_dir}/interim"), Folder(spark, f"{output_dir}/output")

    def raw(name: str) -> str:
        return f"{input_dir}/{name}.{fmt}"

    calls = read_harmonised(
        spark, [raw(f"assistance_{y}") for y in YEARS], N.RAW_CALLS, N.CALL_RENAMES, N.CALL_DROPS, fmt, keep_order=True
    )
    models = read_table(spark, raw("vehicle_model"), N.VEHICLE_MODELS, fmt)
    cleaned = interim.keep("calls", cases.add_cases(cases.clean_calls(calls, models), sizes_from=calls))

    lines = read_table(spark, raw("qlines"), N.RAW_LINES, fmt).withColumnRenamed("FIN", "VIN")
    ends = read_table(spark, raw("qlines_repair_end"), N.RAW_ENDS, fmt)
    stays = interim.keep(
        "stays",
        cases.build_stays(
            lines.withColumn("Reparaturbeginndatum", parse_date("Reparaturbeginndatum", ["yyyyMMdd"])),
            ends.withColumn("Reparaturendedatum", parse_date("Reparaturendedatum", ["yyyyMMdd"])),
        ),
    )
    linked = interim.keep("merged", cases.link_cases(cleaned, stays).drop(SOURCE_ORDER))
    sweeps = output.keep("num_merges_by_part", cases.link_sweep(linked, cases.SWEEPS))
    output.keep("num_merges", sweeps.filter("part = 'tow'").drop("part"))
    output.keep("num_merges_not_on_towing", sweeps.filter("part = 'last_call'").drop("part"))
    bridge = interim.keep("fall_id_to_aufenthalt_id", cases.case_stay_bridge(linked))
    scored = interim.keep("scored", cases.score_calls(cleaned.drop(SOURCE_ORDER), linked, stays))
    assistance = interim.keep("assistance", cases.mark_suspects(scored))
    for name, table in reports.score_distribution(assistance).items():
        output.keep(name, table)
    unlinked = interim.keep("unmerged_fall_ids", cases.unlinked_tows(assistance, bridge))
    interim.keep("workshop", cases.flag_stays(stays, unlinked, bridge))


def analyse(spark: SparkSession, output_dir: str, words_from: DataFrame | None = None, stopwords: DataFrame | None = None) -> None:
    """Write every report; with ``words_from`` also the most frequent words of its fault texts."""
    assistance = Folder(spark, f"{output_dir}/interim").read("assistance")
    output = Folder(spark, f"{output_dir}/output/analysis")
    for name, table in reports.analyse(assistance, output.keep).items():
        output.keep(name.replace(" ", "_"), table)
    if words_from is not None:
        output.keep("most_common_words", A.top_words(words_from, "Fault Description Customer", 200, stopwords))


def learn(
    spark: SparkSession,
    output_dir: str,
    train_model: bool = False,
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = 5,
) -> None:
    """Features, clusters and classifiers; models are fitted or, by default, loaded."""
    grids = grids or {}
    interim, output = Folder(spark, f"{output_dir}/interim"), Folder(spark, f"{output_dir}/output/learning")
    models = f"{output_dir}/models"
    calls, repairs = interim.read("assistance"), interim.read("workshop")
    contract = Folder(spark, models)
    if not train_model:
        # A missing model is named before anything else is read.
        load_model(f"{models}/clusters")
    # A model line that is new would shift the numbers of those after it under a loaded model.
    codes = contract.keep("model_codes", learning.model_codes(calls)) if train_model else contract.read("model_codes")
    features = learning.vehicle_features(calls, repairs, codes=codes)
    if train_model:
        columns = list(enumerate(learning.numeric_features(features)))
        contract.keep("features", spark.createDataFrame(columns, "place int, feature string"))
    # Levels found in other data would shift the columns under a loaded model.
    known = [row["feature"] for row in contract.read("features").orderBy("place").collect()]
    features = interim.keep("features", learning.align(features, known))

    if train_model:
        fitted = learning.cluster_vehicles(features)
        save_model(fitted.model, f"{models}/clusters")
        meant = dict(zip(learning.safe_names(features)[1], learning.numeric_features(features)))
        renames = F.create_map(*[F.lit(x) for pair in meant.items() for x in pair])
        loadings = fitted.loadings.withColumn("feature", renames[F.col("feature")])
        output.keep("explained_variance", fitted.variance)
        output.keep("silhouette_scores", fitted.silhouettes)
        output.keep("top_loadings", cluster.top_loadings(loadings))
    clusters = load_model(f"{models}/clusters")
    clustered = interim.keep("clustered", learning.with_clusters(clusters, features))
    output.keep("vehicle_silhouettes", learning.vehicle_silhouettes(clusters, features))
    for name, table in learning.describe(clustered).items():
        output.keep(name.replace(" ", "_").replace(">", "over"), table)

    if train_model:
        save_model(learning.fit_suspects(features, grids.get("suspects"), folds), f"{models}/suspects")
        save_model(learning.fit_merged(calls, repairs, grids.get("merged"), folds), f"{models}/merged")
    frame, plain, meant_names = learning.safe_names(features)
    suspects = load_model(f"{models}/suspects")
    test = C.hash_split(frame, learning.ENTITY)[1]
    for name, table in learning.judge(interim.keep("suspect_scores", C.score(suspects, test, "Suspect"))).items():
        output.keep(f"suspect_{name}", table)
    back = F.create_map(*[F.lit(x) for pair in zip(plain, meant_names) for x in pair])
    ranked = C.importances(suspects, frame)
    output.keep("suspect_importances", ranked.withColumn("feature", back[F.col("feature")]))

    merged = load_model(f"{models}/merged")
    counted = learning.with_repair_count(calls, repairs)
    test = C.hash_split(counted, "Case Number")[1]
    for name, table in learning.judge(interim.keep("merged_scores", C.score(merged, test, "Merged"))).items():
        output.keep(f"merged_{name}", table)
    output.keep("merged_importances", C.importances(merged, counted, learning.MERGED_CATEGORIES, learning.MERGED_NUMBERS))


def run(
    spark: SparkSession,
    stages: Sequence[str],
    input_dir: str,
    output_dir: str,
    train_model: bool = False,
    fmt: str = "csv",
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = 5,
    input_bytes: int | None = None,
) -> None:
    """Run the named stages in their fixed order; ``input_bytes`` sizes the shuffles."""
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    tune(spark, input_bytes)
    if "data_preparation" in stages:
        run_preparation(spark, input_dir, output_dir, fmt)
    if "analysis" in stages:
        analyse(spark, output_dir)
    if "machine_learning" in stages:
        learn(spark, output_dir, train_model, grids, folds)
