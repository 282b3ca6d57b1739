"""Written intermediate tables, positions in a global order, running totals of hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.session import scratch_path

#: Rows that one slice of a running total holds at most, on average.
SLICE_ROWS = 500_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared scratch folder and read from there.

    Joins of kept tables start from plain shuffles, whose skewed partitions adaptive
    execution splits, so a key that holds a third of all rows needs no salt there.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._scratch = path
    return kept


def release(*tables: DataFrame) -> None:
    """Remove tables of ``keep`` from the scratch folder.

    Only for tables that nothing reads any more: what was made of them has been written itself, so
    a lost executor never asks for them again.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def digits_for(rows: int) -> int:
    """Leading hex digits of a digest that cut so many rows into slices of ``SLICE_ROWS``."""
    digits = 2
    while rows > SLICE_ROWS * 16**digits:
        digits += 1
    return digits


def running(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str, digits: int
) -> DataFrame:
    """Total of ``value`` over the rows of the same keys that come before, in the order of ``order``.

    The first column of ``order`` is a lower-case hex digest. Its leading digits cut every key
    into slices; slices are totalled on their own and hand their totals on, so a key's rows
    never meet in one task. Keys must not be null. ``digits`` changes the cuts, not the result.
    """
    keys = list(keys)
    sliced = rows.withColumn("_slice", F.substring(order[0], 1, digits))
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.join(starts, [*keys, "_slice"])
        .withColumn(into, F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_slice", "_start")
    )


def positions(df: DataFrame, order: Sequence, into: str, label: str) -> DataFrame:
    """The rows with their position (from 0) in the global order of ``order``.

    Rows are dealt by range and sorted there; only the row count of each range is gathered.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    place = F.struct(F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("row"))
    return numbered(keep(parts.withColumn("_place", place).drop("_at"), label), into)


def numbered(parts: DataFrame, into: str) -> DataFrame:
    """Positions (from 0) of the rows of a kept table whose ``_place`` has their part and row in it, both in order."""
    sizes = parts.groupBy(F.col("_place.part").alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # One row per part.
    found = parts.join(F.broadcast(starts), F.col("_place.part") == F.col("_part"))
    return found.withColumn(into, F.col("_start") + F.col("_place.row")).drop("_place", "_part", "_start")
