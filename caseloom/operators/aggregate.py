"""Counts, profiles and reshaping. Rows with a missing key take no part."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.clean import as_column
from caseloom.functions.text import tokens
from caseloom.operators.quantiles import MAX_DISTINCT, quantiles
from caseloom.operators.skew import spread_join

#: Found levels that become columns of a wide table; more are counted as sparse vectors.
MAX_LEVELS = 10_000
#: Parts that a crosstab deals the levels of its columns into.
GRID_PARTS = 64


def known_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which all the columns are known."""
    return df.filter(reduce(lambda a, b: a & b, [as_column(c).isNotNull() for c in cols])) if cols else df


def levels(df: DataFrame, col: str, limit: int = MAX_LEVELS) -> list:
    """Sorted distinct values of a category; more than ``limit`` of them is an error."""
    found = known_rows(df.select(as_column(col).alias("level")), ["level"]).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{col!r} has more than {limit} levels")
    return sorted(r["level"] for r in found)


def wide_levels(df: DataFrame, col: str) -> list | None:
    """Sorted distinct values of a category, or nothing if there are too many for columns."""
    found = known_rows(df.select(as_column(col).alias("level")), ["level"]).distinct().limit(MAX_LEVELS + 1).collect()
    return sorted(r["level"] for r in found) if len(found) <= MAX_LEVELS else None


def joint_counts(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per combination of categories, missing ones included.

    One pass over the rows from which counts of any of the columns follow, see ``weight``.
    """
    return df.groupBy(*[as_column(c) for c in cols]).agg(F.count(F.lit(1)).alias(name))


def value_counts(
    df: DataFrame, cols: str | Sequence[str], normalize: bool = False, name: str = "n", weight: str | None = None
) -> DataFrame:
    """Rows per value or combination of values; with ``normalize`` also their share.

    ``weight`` names a column that says how many rows a row stands for.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    rows = known_rows(df, cols)
    number = F.count(F.lit(1)) if weight is None else F.sum(as_column(weight))
    counts = rows.groupBy(*[as_column(c) for c in cols]).agg(number.alias(name))
    if normalize:
        total = rows.agg(number).scalar()
        counts = counts.withColumn("share", F.col(name) / total)
    return counts


def most_common(counts: DataFrame, name: str = "n") -> DataFrame:
    """Counts in descending order, equal ones by value."""
    return counts.orderBy(F.col(name).desc(), *[as_column(c) for c in counts.columns if c not in (name, "share")])


def entity_aggregates(
    df: DataFrame, keys: Sequence[str], count: str = "n", sums: Sequence[str] = (), means: Sequence[str] = ()
) -> DataFrame:
    """Per entity: rows, sums (flags count as 0/1) and means of columns."""
    kinds = dict(df.dtypes)

    def number(c: str) -> Column:
        return as_column(c).cast("bigint") if kinds[c] == "boolean" else as_column(c)

    return (
        known_rows(df, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias(count),
            *[F.coalesce(F.sum(number(c)), F.lit(0)).alias(f"sum_{c}") for c in sums],
            *[F.avg(number(c)).alias(f"mean_{c}") for c in means],
        )
    )


def n_unique(df: DataFrame, keys: Sequence[str], col: str, name: str = "n_unique") -> DataFrame:
    """Distinct values of a column per entity."""
    return known_rows(df, keys).groupBy(*keys).agg(F.count_distinct(as_column(col)).alias(name))


def filtered_count(df: DataFrame, keys: Sequence[str], condition: Column, name: str = "n") -> DataFrame:
    """Rows per entity that fulfil a condition; entities without any do not appear."""
    return known_rows(df, keys).filter(condition).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def zscore(df: DataFrame, col: str, name: str = "zscore") -> DataFrame:
    """Add the distance from the mean in sample standard deviations, null if these are zero."""
    stats = df.agg(F.struct(F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd")).alias("s")).scalar()
    return df.withColumn(name, F.try_divide(F.col(col) - stats["mean"], stats["sd"]))


def _nice_step(span: Column, maxbins: int) -> Column:
    """Width of the form 1, 2 or 5 times a power of ten that needs at most ``maxbins`` bins."""
    digits = math.ceil(math.log10(maxbins))
    step = F.pow(F.lit(10.0), F.floor(F.log10(span) + 0.5) - F.lit(digits))
    for _ in range(2):
        step = F.when(F.ceil(span / step) > maxbins, step * 10).otherwise(step)
    for divisor in (5, 2):
        step = F.when(span / (step / divisor) <= maxbins, step / divisor).otherwise(step)
    return step


def histogram(
    df: DataFrame, col: str, maxbins: int = 10, step: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Rows per bin ``bin_start``..``bin_end``, of a given width or at most ``maxbins`` round ones.

    Bins are closed on the left; a largest value on the last edge belongs to the last bin.
    """
    rows = known_rows(df, [col, *by])
    value = as_column(col).cast("double")
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(
        F.when(F.col("lo") != 0, F.abs("lo")).otherwise(F.lit(1.0))
    )
    edges = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).withColumn(
        "step", F.lit(float(step)) if step is not None else _nice_step(span, maxbins)
    )
    grid = edges.select(
        F.struct(
            F.col("step").alias("step"),
            F.floor(F.col("lo") / F.col("step")).alias("first"),
            F.greatest(F.ceil(F.col("hi") / F.col("step")) - 1, F.floor(F.col("lo") / F.col("step"))).alias("last"),
        )
    ).scalar()
    index = F.least(F.floor(value / grid["step"] + 1e-14), grid["last"])
    counts = rows.select(*by, index.alias("_bin"), grid["step"].alias("_step")).groupBy(*by, "_bin", "_step")
    return counts.agg(F.count(F.lit(1)).alias("n")).select(
        *by,
        (F.col("_bin") * F.col("_step")).alias("bin_start"),
        ((F.col("_bin") + 1) * F.col("_step")).alias("bin_end"),
        "n",
    )


def crosstab(
    df: DataFrame, a: str, b: str, b_levels: Sequence | None = None, weight: str | None = None
) -> DataFrame:
    """Long table ``a, b, n, row_total`` with every combination, zeros included.

    Levels of ``b`` are dealt into ``GRID_PARTS`` parts by hash. A row of the crosstab meets the
    parts one by one, and its counts in a part are one map, so neither a list of all levels nor
    a row's whole line is ever in one place, however many levels there are.
    """
    counts = value_counts(df, [a, b], weight=weight)
    part = F.pmod(F.xxhash64(as_column(b)), F.lit(GRID_PARTS)).cast("int").alias("_part")
    if b_levels is None:
        found = counts.select(as_column(b)).distinct()
    else:
        counts = counts.filter(as_column(b).isin(*b_levels))
        kind = counts.schema[b].dataType
        given = F.array(*[F.lit(level).cast(kind) for level in b_levels])
        found = df.sparkSession.range(1).select(F.explode(given).alias(b))
    level_parts = found.groupBy(part).agg(F.collect_list(as_column(b)).alias("_levels"))
    per_part = counts.groupBy(as_column(a), part).agg(
        F.map_from_entries(F.collect_list(F.struct(as_column(b), F.col("n")))).alias("_cells")
    )
    per_row = counts.groupBy(as_column(a)).agg(F.sum("n").alias("row_total"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(GRID_PARTS - 1))).alias("_part")
    grid = per_row.select(as_column(a), "row_total", parts).join(level_parts, "_part").join(per_part, [a, "_part"], "left")
    cells = F.explode(
        F.transform("_levels", lambda level: F.struct(level.alias("b"), F.coalesce(F.col("_cells")[level], F.lit(0)).alias("n")))
    )
    return grid.select(as_column(a), "row_total", cells.alias("_c")).select(
        as_column(a), F.col("_c.b").alias(b), F.col("_c.n").cast("bigint").alias("n"), "row_total"
    )


def ordered_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """The crosstab with its rows by descending total."""
    return crosstab(df, a, b).orderBy(F.col("row_total").desc(), as_column(a), as_column(b))


TIMELINE_BUCKETS = {"month": "month", "quarter": "quarter", "quarter_month": "month"}


def timeline(df: DataFrame, ts: str, bucket: str = "month") -> DataFrame:
    """Rows per month or quarter; ``quarter_month`` counts months and adds their quarter."""
    period = F.trunc(as_column(ts), TIMELINE_BUCKETS[bucket])
    counts = known_rows(df, [ts]).groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    if bucket == "quarter_month":
        counts = counts.withColumn("quarter", F.quarter("period"))
    return counts


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per input row and column."""
    return df.unpivot([as_column(i) for i in ids], [as_column(c) for c in cols], name, value)


def melt_sum(df: DataFrame, by: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "total") -> DataFrame:
    """Sum of the positive values per group and column; sums of zero do not appear."""
    wide = df.groupBy(*by).agg(*[F.sum(F.when(as_column(c) > 0, as_column(c))).alias(c) for c in cols])
    return known_rows(unpivot(wide, by, cols, name, value), [value])


def profile_groups(
    df: DataFrame, by: str, cols: Sequence[str], max_group_rows: int = MAX_DISTINCT
) -> DataFrame:
    """Mean and median of number columns per group: ``feature, by, kind, value``."""
    rows = known_rows(df, [by]).select(as_column(by), *[as_column(c).cast("double").alias(c) for c in cols])
    means = unpivot(rows.groupBy(by).agg(*[F.avg(as_column(c)).alias(c) for c in cols]), [by], cols)
    long = unpivot(rows, [by], cols)
    medians = quantiles(long, "value", (0.5,), by=[by, "feature"], names=["value"], max_group_rows=max_group_rows)
    return known_rows(means, ["value"]).select("feature", by, F.lit("Mean").alias("kind"), "value").unionByName(
        medians.select("feature", by, F.lit("Median").alias("kind"), "value")
    )


def profile_nominal(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Share of each value of nominal columns within a group: ``feature, by, level, share``."""
    text = df.select(as_column(by), *[as_column(c).cast("string").alias(c) for c in cols])
    counts = value_counts(unpivot(text, [by], cols, "feature", "level"), [by, "feature", "level"])
    totals = counts.groupBy(by, "feature").agg(F.sum("n").alias("_total"))
    return spread_join(counts, totals, [by, "feature"], "inner").select("feature", by, "level", "n", (F.col("n") / F.col("_total")).alias("share"))


def pivot_counts(
    df: DataFrame, key: str, col: str, col_levels: Sequence[str] | None = None, prefix: str = ""
) -> DataFrame:
    """One count column per level of a category, one row per entity.

    Levels are found if none are given. If more than ``MAX_LEVELS`` are found, there is one column
    instead, ``{prefix}counts``: sparse vectors with a place per level in sorted order, and one more.
    """
    rows = known_rows(df, [key, col])
    col_levels = col_levels if col_levels is not None else wide_levels(rows, col)
    if col_levels is None:
        from caseloom.operators.features import sparse_counts, sparse_vectors

        counts, codes = sparse_counts(rows, key, col)
        return sparse_vectors(counts, key, codes, f"{prefix}counts")
    return rows.groupBy(key).agg(*[F.count_if(as_column(col) == level).alias(f"{prefix}{level}") for level in col_levels])


def service_influence(
    df: DataFrame, dims: Sequence[str], services: Sequence[str], name: str = "service", value: str = "offered"
) -> DataFrame:
    """Rows per combination of dimensions, service and whether it was offered."""
    long = unpivot(df.select(*[as_column(c) for c in (*dims, *services)]), dims, services, name, value)
    return value_counts(long, [*dims, name, value])


def word_counts(df: DataFrame, col: str, stopwords: DataFrame | None = None, stopword_col: str = "stopwords") -> DataFrame:
    """Occurrences of each word that is neither a stopword nor a number."""
    words = df.select(F.explode(tokens(col)).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(~F.col("word").rlike(r"(?U)^\d+$"))
    if stopwords is None:
        return counts
    dropped = stopwords.select(F.lower(as_column(stopword_col)).alias("word")).distinct()
    return counts.join(dropped, "word", "left_anti")


def top_words(
    df: DataFrame, col: str, n: int = 200, stopwords: DataFrame | None = None, stopword_col: str = "stopwords"
) -> DataFrame:
    """The ``n`` most frequent words, equal counts in word order."""
    counts = word_counts(df, col, stopwords, stopword_col)
    return counts.orderBy(F.col("n").desc(), F.col("word")).limit(n)


def top_n_abs(df: DataFrame, by: str, value: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows of largest absolute value per group, with their rank."""
    window = Window.partitionBy(by).orderBy(F.abs(F.col(value)).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def named_counts(df: DataFrame, col: str, names: Mapping[str, str]) -> DataFrame:
    """Rows per code with its name, and per name where several codes share one."""
    counts = value_counts(df, col)
    table = F.create_map(*[F.lit(item) for pair in names.items() for item in pair])
    return counts.select(as_column(col).alias("code"), table[as_column(col)].alias("name"), "n")
