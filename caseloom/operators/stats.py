"""Tests, regression, correlation and summaries. Each is a few aggregates over the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions import special
from caseloom.functions.clean import as_column, holds
from caseloom.functions.dates import floor_days
from caseloom.operators.aggregate import crosstab, known_rows, unpivot
from caseloom.operators.quantiles import MAX_DISTINCT, quantiles

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(special)


def _on_summary(function, *args) -> Column:
    """A scalar Python function on a one-row summary."""
    return F.udf(function, T.DoubleType())(*args)


def chi_square(
    df: DataFrame, a: str, b: str, alpha: float = 0.05, weight: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Chi-square test of independence: one summary row, and one row per cell.

    Cells hold observed, expected and residual counts of every combination. With one degree
    of freedom the statistic uses the Yates continuity correction.
    """
    grid = crosstab(df, a, b, weight=weight)
    columns = grid.groupBy(as_column(b).alias("_b")).agg(F.sum("n").alias("_col_total"))
    total = grid.agg(F.sum("n")).scalar()
    cells = (
        grid.join(columns, as_column(b) == F.col("_b"))
        .withColumn("expected", F.col("row_total") * F.col("_col_total") / total)
        .select(as_column(a), as_column(b), F.col("n").alias("observed"), "expected", (F.col("n") - F.col("expected")).alias("residual"))
    )
    off = F.abs("residual")
    plain = F.sum(F.pow(off, F.lit(2.0)) / F.col("expected"))
    yates = F.sum(F.pow(off - F.least(F.lit(0.5), off), F.lit(2.0)) / F.col("expected"))
    shape = cells.agg(
        plain.alias("_plain"),
        yates.alias("_yates"),
        ((F.count_distinct(as_column(a)) - 1) * (F.count_distinct(as_column(b)) - 1)).alias("dof"),
    )
    summary = shape.select(
        F.when(F.col("dof") == 1, F.col("_yates")).otherwise(F.col("_plain")).alias("statistic"), "dof"
    ).withColumn("p_value", _on_summary(special.chi2_tail, "statistic", F.col("dof").cast("double")))
    return summary.withColumn("significant", holds(F.col("p_value") < alpha)), cells


def ols(df: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Least-squares line with inference: one summary row, and the rows with ``predicted``."""
    xs, ys = as_column(x).cast("double"), as_column(y).cast("double")
    rows = known_rows(df, [x, y])
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(xs).alias("_mx"),
        F.regr_sxx(ys, xs).alias("_sxx"),
        F.regr_syy(ys, xs).alias("_syy"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_r2(ys, xs).alias("r2"),
    )
    free = F.col("n") - 2
    rss = F.greatest((1 - F.col("r2")) * F.col("_syy"), F.lit(0.0))
    sigma2 = F.try_divide(rss, free)
    summary = (
        sums.withColumn("dof", free.cast("double"))
        .withColumn("slope_se", F.sqrt(F.try_divide(sigma2, F.col("_sxx"))))
        .withColumn("intercept_se", F.sqrt(sigma2 * (1 / F.col("n") + F.try_divide(F.col("_mx") * F.col("_mx"), F.col("_sxx")))))
        .withColumn("adj_r2", 1 - (1 - F.col("r2")) * F.try_divide(F.col("n") - 1, free))
        .withColumn("f_statistic", F.try_divide(F.col("r2"), F.try_divide(1 - F.col("r2"), free)))
        .withColumn("log_likelihood", -F.col("n") / 2 * (F.lit(math.log(2 * math.pi) + 1) + F.log(rss / F.col("n"))))
        .withColumn("aic", 4 - 2 * F.col("log_likelihood"))
        .withColumn("bic", 2 * F.log(F.col("n")) - 2 * F.col("log_likelihood"))
        .withColumn("_reach", _on_summary(special.t_reach, "dof"))
        .withColumn("f_p", _on_summary(special.f_tail, "f_statistic", F.lit(1.0), "dof"))
    )
    for term in ("slope", "intercept"):
        summary = (
            summary.withColumn(f"{term}_t", F.try_divide(F.col(term), F.col(f"{term}_se")))
            .withColumn(f"{term}_p", _on_summary(special.t_tail, f"{term}_t", "dof"))
            .withColumn(f"{term}_low", F.col(term) - F.col("_reach") * F.col(f"{term}_se"))
            .withColumn(f"{term}_high", F.col(term) + F.col("_reach") * F.col(f"{term}_se"))
        )
    summary = summary.drop("_mx", "_sxx", "_syy", "_reach")
    line = sums.select(F.struct("slope", "intercept")).scalar()
    return summary, rows.withColumn("predicted", line["intercept"] + line["slope"] * xs)


def policy_offsets(df: DataFrame, at: str, start: str, end: str, horizon: int = 730) -> DataFrame:
    """Rows with 1..``horizon`` days left until the end; ``days_since_start`` where 0..``horizon``."""
    rows = known_rows(df, [at, start, end]).withColumn("days_until_end", floor_days(at, end))
    rows = rows.filter((F.col("days_until_end") > 0) & (F.col("days_until_end") <= horizon))
    since = floor_days(start, at)
    return rows.withColumn("days_since_start", F.when(since.between(0, horizon), since))


def policy_edge(df: DataFrame, at: str, start: str, end: str, horizon: int = 730) -> DataFrame:
    """Rows per day before the end and per day since the start: ``edge, day, n``."""
    offsets = policy_offsets(df, at, start, end, horizon).select(
        F.col("days_until_end").alias("until_end"), F.col("days_since_start").alias("since_start")
    )
    long = offsets.unpivot([], ["until_end", "since_start"], "edge", "day")
    return known_rows(long, ["day"]).groupBy("edge", "day").agg(F.count(F.lit(1)).alias("n"))


def corr_matrix(df: DataFrame, cols: Sequence[str], complete: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of all pairs of flags or numbers, long form.

    Rows must be complete in ``complete``, by default in all the columns. Constant columns
    have no correlation.
    """
    rows = known_rows(df, cols if complete is None else complete)
    rows = rows.select(*[as_column(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = list(combinations_with_replacement(range(len(cols)), 2))

    def pearson(i: int, j: int) -> Column:
        both = F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()
        spread = F.stddev_samp(F.when(both, F.col(f"c{i}"))) * F.stddev_samp(F.when(both, F.col(f"c{j}")))
        return F.try_divide(F.covar_samp(f"c{i}", f"c{j}"), spread)

    values = rows.agg(*[pearson(i, j).alias(f"r{i}_{j}") for i, j in pairs])
    cells = []
    for i, j in pairs:
        for one, two in {(i, j), (j, i)}:
            cells.append(
                F.struct(
                    F.lit(cols[one]).alias("variable1"),
                    F.lit(cols[two]).alias("variable2"),
                    F.col(f"r{i}_{j}").alias("correlation"),
                )
            )
    return values.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def summary_stats(
    df: DataFrame, col: str, ps: Sequence[float] = (0.1, 0.9), max_group_rows: int = MAX_DISTINCT
) -> DataFrame:
    """Mean, median and quantiles as rows ``statistic, value``."""
    points = (0.5, *ps)
    labels = ["Median", *[f"Q{p:g}" for p in ps]]
    ranked = unpivot(quantiles(df, col, points, names=labels, max_group_rows=max_group_rows), [], labels, "statistic")
    mean = df.agg(F.avg(as_column(col)).alias("value")).select(F.lit("Mean").alias("statistic"), "value")
    return mean.unionByName(ranked)


def normal_curve(df: DataFrame, col: str, points: int = 100) -> DataFrame:
    """Density of the normal distribution fitted to a column, at evenly spaced points."""
    stats = df.agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), F.min(col).alias("lo"), F.max(col).alias("hi")
    )
    steps = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(points - 1)
    z = F.try_divide(F.col("x") - F.col("mean"), F.col("sd"))
    density = F.try_divide(F.exp(-z * z / 2), F.col("sd") * F.lit(math.sqrt(2 * math.pi)))
    return steps.withColumn("x", x).select("x", density.alias("density"))
