"""Equi-join patterns. Build sides are left to Spark, which knows their sizes.

Null keys match nothing unless an operator says otherwise. Hot keys of the rows are spread,
see :func:`caseloom.operators.skew.spread_join`; ``sizes_from`` is handed to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.clean import as_column
from caseloom.operators.skew import MAX_GROUP_ROWS, spread_join


def _keys(others: DataFrame, key: str, name: str) -> DataFrame:
    return others.select(as_column(key).alias(name)).filter(as_column(name).isNotNull()).distinct()


def semi(
    df: DataFrame, others: DataFrame, key: str, other_key: str | None = None,
    max_group_rows: int = MAX_GROUP_ROWS, sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return spread_join(df, _keys(others, other_key or key, key), [key], "left_semi", max_group_rows, sizes_from)


def anti(
    df: DataFrame, others: DataFrame, key: str, other_key: str | None = None,
    max_group_rows: int = MAX_GROUP_ROWS, sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Rows whose key does not occur in the other table, rows without a key included."""
    return spread_join(df, _keys(others, other_key or key, key), [key], "left_anti", max_group_rows, sizes_from)


def flag_exists(
    df: DataFrame, others: DataFrame, key: str, name: str, other_key: str | None = None,
    max_group_rows: int = MAX_GROUP_ROWS, sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Add a boolean: does the key occur in the other table?"""
    found = _keys(others, other_key or key, key).withColumn("_found", F.lit(True))
    joined = spread_join(df, found, [key], "left", max_group_rows, sizes_from)
    return joined.select(*[as_column(c) for c in df.columns], F.coalesce("_found", F.lit(False)).alias(name))


def null_if_missing_in(
    df: DataFrame, col: str, dim: DataFrame, key: str,
    max_group_rows: int = MAX_GROUP_ROWS, sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Null values that are no key of the dimension."""
    flagged = flag_exists(df, dim, col, "_member", key, max_group_rows, sizes_from)
    return flagged.select(*[F.when(F.col("_member"), as_column(c)).alias(c) if c == col else as_column(c) for c in df.columns])


def lookup(
    df: DataFrame, dim: DataFrame, key: str, value: str, default=None, dim_key: str | None = None, name: str | None = None,
    max_group_rows: int = MAX_GROUP_ROWS, sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Add the dimension's value for the key, or the default. Dimension keys must be unique."""
    values = dim.select(as_column(dim_key or key).alias(key), as_column(value).alias("_value"))
    joined = spread_join(df, values, [key], "left", max_group_rows, sizes_from)
    return joined.select(
        *[as_column(c) for c in df.columns], F.coalesce(F.col("_value"), F.lit(default)).alias(name or value)
    )


def fallback_join(
    df: DataFrame,
    dim: DataFrame,
    primary: str,
    dim_primary: str,
    secondary: str,
    dim_secondary: str,
    coarse_cols: Sequence[str],
    max_group_rows: int = MAX_GROUP_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Enrich by the primary key; where the dimension lacks it, by a coarser secondary key.

    ``coarse_cols`` are the dimension columns that the secondary key determines; the others
    stay null in fallback rows, as does an unknown primary key. If several dimension rows
    share a key, each of them gives a row.
    """
    extra = [c for c in dim.columns if c != dim_primary]
    fine = (
        dim.filter(as_column(dim_primary).isNotNull())
        .distinct()
        .select(as_column(dim_primary).alias("_p"), F.lit(True).alias("_hit"), *[as_column(c).alias(f"_f_{c}") for c in extra])
    )
    coarse = (
        dim.filter(as_column(dim_secondary).isNotNull())
        .select(as_column(dim_secondary).alias("_s"), *[as_column(c).alias(f"_c_{c}") for c in coarse_cols])
        .distinct()
    )
    base = df if sizes_from is None else sizes_from
    step = spread_join(
        df.withColumn("_p", as_column(primary)), fine, ["_p"], "left", max_group_rows, base.select(as_column(primary).alias("_p"))
    )
    # Rows the primary key served take no part in the second join.
    missed = F.when(F.col("_hit").isNull(), as_column(secondary))
    step = spread_join(
        step.withColumn("_s", missed), coarse, ["_s"], "left", max_group_rows, base.select(as_column(secondary).alias("_s"))
    )
    hit = F.col("_hit").isNotNull()
    own = [F.when(hit, as_column(c)).alias(c) if c == primary else as_column(c) for c in df.columns]
    added = [
        (F.coalesce(as_column(f"_f_{c}"), as_column(f"_c_{c}")) if c in coarse_cols else as_column(f"_f_{c}")).alias(c)
        for c in extra
    ]
    return step.select(*own, F.when(hit, F.col("_p")).alias(dim_primary), *added)
