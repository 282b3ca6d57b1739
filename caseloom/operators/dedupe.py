"""Distinct rows and one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.clean import as_column
from caseloom.operators.ordered import MAX_GROUP_ROWS, OrderedGroups


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct, nulls equal to each other."""
    return df.distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row of each key under a unique order.

    Spark keeps one candidate per key on the map side before it shuffles (window group
    limit), so a hot key sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() for o in order_by])
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def split_last_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Last row of each key under a unique order, and all the earlier rows."""
    # As fields of a struct, missing keys equal each other.
    keyed = df.withColumn("_key", F.struct(*[as_column(k) for k in keys]))
    scan = OrderedGroups(keyed, ["_key"], order_by, descending=True, max_group_rows=max_group_rows)
    marked = scan.previous(_later=F.lit(True)).result()
    columns = [as_column(c) for c in df.columns]
    return marked.filter(F.col("_later").isNull()).select(*columns), marked.filter("_later").select(*columns)
