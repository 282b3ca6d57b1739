"""Exact quantiles with linear interpolation, and filters built on them.

Values are counted before they are ranked. Spark's ``percentile`` holds one entry per
distinct value of a group in a single buffer, so it is used only while every group has few
distinct values; beyond that the ranks come from a sliced running sum. Both give the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.clean import as_column
from caseloom.operators.ordered import OrderedGroups
from caseloom.operators.skew import MAX_GROUP_ROWS, spread_join

# Distinct values of a group that one aggregation buffer may hold.
MAX_DISTINCT = 1_000_000


def _value_counts(df: DataFrame, col: str | Column, by: Sequence[str]) -> DataFrame:
    counts = df.select(*by, as_column(col).alias("_value")).filter(F.col("_value").isNotNull())
    for key in by:
        counts = counts.filter(F.col(f"`{key}`").isNotNull())
    return counts.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n"))


def _pick(
    rows: DataFrame, counts: DataFrame, ps: Sequence[float], by: Sequence[str], max_group_rows: int
) -> DataFrame:
    names = [f"_q{i}" for i in range(len(ps))]
    # Few rows cannot have many distinct values.
    few = rows.count() <= max_group_rows
    groups = None if few else OrderedGroups(counts, by, ["_value"], max_group_rows=max_group_rows)
    if groups is None or not groups.sliced:
        points = F.percentile("_value", F.array(*[F.lit(float(p)) for p in ps]), F.col("_n"))
        picked = counts.groupBy(*by).agg(points.alias("_qs"))
        return picked.select(*by, *[F.col("_qs")[i].alias(n) for i, n in enumerate(names)])
    ranked = groups.running_sum("_upto", "_n").result()
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    if by:
        ranked = spread_join(ranked, totals, by, "inner", max_group_rows, counts)
    else:
        ranked = ranked.withColumn("_total", totals.scalar())
    picks = []
    for i, p in enumerate(ps):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        picks.append(F.min(F.when(F.col("_upto") > F.floor(rank), F.col("_value"))).alias(f"_lo{i}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(rank), F.col("_value"))).alias(f"_hi{i}"))
        picks.append(F.max(rank).alias(f"_rank{i}"))
    picked = ranked.groupBy(*by).agg(*picks)
    return picked.select(*by, *[_between(i).alias(n) for i, n in enumerate(names)])


def _between(i: int) -> Column:
    """Interpolates as ``percentile`` does, to the last bit."""
    low, high, rank = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double"), F.col(f"_rank{i}")
    mixed = (F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high
    return F.when(low == high, low).otherwise(mixed)


def quantiles(
    df: DataFrame,
    col: str | Column,
    ps: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    max_group_rows: int = MAX_DISTINCT,
) -> DataFrame:
    """Exact quantiles of a column, one column per ``ps`` and one row per group."""
    names = list(names or [f"q{p:g}" for p in ps])
    picked = _pick(df, _value_counts(df, col, by), ps, by, max_group_rows)
    return picked.select(*by, *[F.col(f"_q{i}").alias(n) for i, n in enumerate(names)])


def count_quantile(per_entity: DataFrame, measure: str | Column, p: float) -> Column:
    """Quantile of an integer measure over entities, as a scalar subquery.

    Such counts add up to at most the rows of the table, so few distinct ones can exist
    (about the square root of twice that number) and one buffer holds them.
    """
    counted = _value_counts(per_entity, measure, ())
    return counted.agg(F.percentile("_value", F.lit(float(p)), F.col("_n"))).scalar()


def remove_outliers(df: DataFrame, col: str, k: float = 1.5, max_group_rows: int = MAX_DISTINCT) -> DataFrame:
    """Keep values between ``q1 - k * iqr`` and ``q3 + k * iqr``."""
    fences = quantiles(df, col, (0.25, 0.75), names=("q1", "q3"), max_group_rows=max_group_rows)
    reach = (F.col("q3") - F.col("q1")) * F.lit(k)
    bounds = fences.select(F.struct((F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))).scalar()
    return df.filter((F.col(col) >= bounds["lo"]) & (F.col(col) <= bounds["hi"]))


def box_stats(df: DataFrame, col: str, by: Sequence[str] = (), max_group_rows: int = MAX_DISTINCT) -> DataFrame:
    """Box-plot summary per group: q1, median, q3 and the outermost values within 1.5 iqr."""
    counts = _value_counts(df, col, by)
    names = ("q1", "median", "q3")
    quarters = _pick(df, counts, (0.25, 0.5, 0.75), by, max_group_rows).select(
        *by, *[F.col(f"_q{i}").alias(n) for i, n in enumerate(names)]
    )
    if by:
        placed = spread_join(counts, quarters, by, "inner", max_group_rows)
    else:
        row = quarters.select(F.struct(*names)).scalar()
        placed = counts.withColumns({n: row[n] for n in names})
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    inside = placed.filter(F.col("_value").between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*by, *names).agg(F.min("_value").alias("whisker_low"), F.max("_value").alias("whisker_high"))


def flag_top_quantile(
    df: DataFrame,
    entity: str,
    measure: Column,
    p: float,
    name: str,
    strict: bool = False,
    among: Column | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Flag rows of entities whose integer measure reaches the p-quantile over entities.

    ``measure`` is an aggregate over an entity's rows, restricted to ``among`` if given:
    entities without such rows take no part in the quantile and are not flagged.
    """
    rows = df.filter(F.col(entity).isNotNull())
    if among is not None:
        rows = rows.filter(among)
    per_entity = rows.groupBy(entity).agg(measure.alias("_measure"))
    limit = F.round(count_quantile(per_entity, "_measure", p), 9)
    top = per_entity.filter(F.col("_measure") > limit if strict else F.col("_measure") >= limit)
    top = top.select(entity, F.lit(True).alias(name))
    joined = spread_join(df, top, [entity], "left", max_group_rows, sizes_from)
    return joined.select(*[as_column(c) for c in df.columns], F.coalesce(name, F.lit(False)).alias(name))
