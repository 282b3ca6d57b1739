"""The analysis stage: one small table per report over scored calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import to_number
from caseloom.functions.clean import as_column
from caseloom.operators import aggregate as A
from caseloom.operators import stats as S
from caseloom.operators.quantiles import box_stats
from caseloom.operators.rows import drop_incomplete
from caseloom.plans.names import COUNTRIES

# Columns the reports look at.
COUNTED = ("Outcome Description", "Component", "Reason Of Call")
CATEGORIES = (*COUNTED, "Report Type")
TESTED = (
    ("Component", "Outcome Description"),
    ("Component", "Reason Of Call"),
    ("Outcome Description", "Reason Of Call"),
    ("Report Type", "Component"),
    ("Report Type", "Outcome Description"),
    ("Report Type", "Reason Of Call"),
)
OFFERED = (
    "Hotel Service",
    "Alternative Transport",
    "Taxi Service",
    "Vehicle Transport",
    "Car Key Service",
    "Parts Service",
)
CORRELATED = (*OFFERED, "Damage During Assistance", "Additional Services Not Covered")
MAPPED = ("Damage During Assistance",)


def country_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per country code and name."""
    return A.named_counts(df, col, COUNTRIES)


def country_totals(df: DataFrame, col: str) -> DataFrame:
    """Rows per country name, codes of one country together."""
    return A.known_rows(country_counts(df, col), ["name"]).groupBy("name").agg(F.sum("n").alias("n"))


def score_distribution(df: DataFrame, score: str | Column = "SuS-O-Meter") -> dict[str, DataFrame]:
    """Histograms of the score and its z-score, and the box-plot summary."""
    scores = df.select((as_column(score)).alias("score"))
    return {
        "score_histogram": A.histogram(scores, "score", maxbins=10),
        "score_standardised": A.histogram(A.zscore(scores, "score"), "zscore", maxbins=10),
        "score_box": box_stats(scores, "score"),
    }


def edge_regression(df: DataFrame, at: str, start: str, end: str, edge: str) -> tuple[DataFrame, DataFrame]:
    """Line through the number of calls per day before the policy's end or after its start."""
    counts = S.policy_edge(df, at, start, end).filter(F.col("edge") == edge)
    return S.ols(counts.select("day", "n"), "day", "n")


def analyse(df: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda _, table: table) -> dict[str, DataFrame]:
    """All reports over the scored calls, by name.

    The categories' joint counts serve most reports, ``keep`` may write them once.
    """
    tables: dict[str, DataFrame] = {}
    joint = keep("category_counts", A.joint_counts(df, CATEGORIES))
    per_vehicle = keep("vehicle_counts", A.value_counts(df, "VIN"))
    policy = ("Incident Date", "Policy Start Date", "Policy End Date")
    tables["policy_edge"] = S.policy_edge(df, *policy)
    for edge in ("until_end", "since_start"):
        tables[f"policy_line_{edge}"], tables[f"policy_fit_{edge}"] = edge_regression(df, *policy, edge)
    tables["counts_Country Of Origin"] = A.value_counts(df, "Country Of Origin")
    for col in COUNTED:
        tables[f"counts_{col}"] = A.value_counts(joint, col, weight="n")
    tables["counts_Component_Outcome"] = A.value_counts(joint, ["Component", "Outcome Description"], weight="n")
    tables["vehicle_histogram"] = A.histogram(per_vehicle, "n", maxbins=30)
    tables["vehicle_normal_curve"] = S.normal_curve(per_vehicle, "n")
    tables["crosstab"] = A.crosstab(joint, "Component", "Outcome Description", weight="n")
    tables["odometer"] = A.histogram(df, "Odometer", maxbins=40)
    tables["services"] = A.service_influence(df, ["Component", "Outcome Description"], OFFERED)
    for col in ("Country Of Origin", "Country Of Incident"):
        tables[f"countries_{col}"] = country_counts(df, col)
    for a, b in TESTED:
        tables[f"chi_square_{a}_{b}"], tables[f"chi_square_cells_{a}_{b}"] = S.chi_square(joint, a, b, weight="n")
    tables["timeline"] = A.timeline(df, "Incident Date", "month")
    damage = as_column("Damage During Assistance")
    answered = df.filter(damage.isNotNull()).withColumn(
        "Damage During Assistance", F.when(damage == "YES", True).when(damage == "NO", False)
    )
    needed = [c for c in CORRELATED if c not in MAPPED]
    # What the correlation leaves out, and for want of which column.
    tables["correlation_rows"] = drop_incomplete(answered, needed)[1]
    tables["correlation"] = S.corr_matrix(answered, CORRELATED, complete=needed)
    rental = df.select(to_number("Rental Car Days").alias("Rental Car Days"))
    tables["rental_days"] = S.summary_stats(rental, "Rental Car Days")
    tables["rental_histogram"] = A.histogram(rental, "Rental Car Days", maxbins=20)
    return tables
