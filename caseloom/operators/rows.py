"""Whole-row helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.clean import as_column


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Put the named columns first, the rest after them in their old order."""
    rest = [c for c in df.columns if c not in first]
    return df.select(*[as_column(c) for c in (*first, *rest)])


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in which all the columns are known, and one row of counts: kept, dropped, per column."""
    missing = reduce(lambda a, b: a | b, [as_column(c).isNull() for c in cols])
    counts = df.agg(
        F.count_if(~missing).alias("kept"),
        F.count_if(missing).alias("dropped"),
        *[F.count_if(as_column(c).isNull()).alias(f"missing_{c}") for c in cols],
    )
    return df.dropna(subset=list(cols)), counts
