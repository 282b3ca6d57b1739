"""One feature row per entity, and label encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from caseloom.functions.clean import as_column, holds
from caseloom.operators.aggregate import known_rows, wide_levels
from caseloom.operators.ordered import position
from caseloom.session import scratch_path


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """The sorted labels of a column numbered from 0, ``label, code``, as a written table.

    Labels are dealt by range, sorted there and numbered by the sizes of the ranges before, so
    any number of them will do.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "labels")
    labels = known_rows(df.select(as_column(col).alias("label")), ["label"]).distinct()
    labels.repartitionByRange("label").sortWithinPartitions("label").withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumns(
        {"_range": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}
    )
    # One row per range.
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    codes = placed.join(starts, "_range").select("label", (F.col("_start") + F.col("_row")).alias("code"))
    numbered = scratch_path(spark, "codes")
    codes.write.parquet(numbered)
    return spark.read.schema(codes.schema).parquet(numbered)


def label_encode(df: DataFrame, col: str, out: str, missing: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Number the sorted labels of a column from 0; missing ones become the label ``missing``.

    Without such a label, rows that lack one are dropped. Returns the coded rows and the
    table of codes, which can be saved with a model.
    """
    if missing is not None:
        df = df.withColumn(col, F.coalesce(as_column(col), F.lit(missing)))
    codes = label_codes(df, col)
    found = codes.toDF("_label", "_code")
    coded = df.join(found, as_column(col) == F.col("_label"))
    return coded.withColumn(out, F.col("_code")).drop("_label", "_code"), codes


def encode_labels(df: DataFrame, col: str, out: str, codes: DataFrame, missing: str | None = None) -> DataFrame:
    """Number labels by a table of codes that an earlier :func:`label_encode` gave, as one saved with a model.

    Labels that the table lacks, and missing ones without ``missing``, get the number after its last.
    """
    value = as_column(col) if missing is None else F.coalesce(as_column(col), F.lit(missing))
    found = codes.toDF("_label", "_code")
    other = codes.agg(F.count(F.lit(1))).scalar()
    coded = df.withColumn("_value", value).join(found, F.col("_value") == F.col("_label"), "left")
    if missing is not None:
        coded = coded.withColumn(col, F.col("_value"))
    return coded.withColumn(out, F.coalesce(F.col("_code"), other)).drop("_label", "_code", "_value")


def sparse_counts(df: DataFrame, key: str, col: str, codes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows per entity and level as two arrays, with the table of codes: ``key, codes, counts``.

    Any number of levels will do, for an entity's arrays hold only those it has. ``codes`` is a
    table of an earlier call; levels that it lacks count together at the number after its last.
    """
    rows = known_rows(df, [key, col])
    codes = label_codes(rows, col) if codes is None else codes
    levels_of = rows.groupBy(as_column(key).alias(key), as_column(col).alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
    coded = encode_labels(levels_of, "_level", "_place", codes)
    places = coded.groupBy(key, F.col("_place").cast("int").alias("_place")).agg(F.sum("_n").alias("_n"))
    cells = places.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_place", "_n"))).alias("_cells"))
    return cells.select(as_column(key), F.col("_cells._place").alias("codes"), F.col("_cells._n").alias("counts")), codes


def sparse_vectors(counts: DataFrame, key: str, codes: DataFrame, out: str) -> DataFrame:
    """The arrays of :func:`sparse_counts` as sparse vectors, as a written table.

    A vector has a place per code and one for all levels without a code.
    """
    size = (codes.agg(F.count(F.lit(1)) + 1).scalar()).cast("int")
    # The stored form of a sparse vector; read under its type, no function in Python has to build it.
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), size.alias("size"), F.col("codes").alias("indices"), F.col("counts").cast("array<double>").alias("values"))
    rows = counts.select(as_column(key), stored.alias(out))
    path = scratch_path(counts.sparkSession, "vectors")
    rows.write.parquet(path)
    schema = StructType([counts.schema[key], StructField(out, VectorUDT())])
    return counts.sparkSession.read.schema(schema).parquet(path)


def label_decode(df: DataFrame, col: str, out: str, codes: DataFrame) -> DataFrame:
    """The labels behind the numbers of :func:`label_encode`; numbers without one have a null."""
    found = codes.toDF("_label", "_code")
    decoded = df.join(found, as_column(col) == F.col("_code"), "left")
    return decoded.withColumn(out, F.col("_label")).drop("_label", "_code")


def _vectors(df: DataFrame, key: str, col: str) -> DataFrame:
    counts, codes = sparse_counts(df, key, col)
    return sparse_vectors(counts, key, codes, f"{col}: counts")


def entity_features(
    calls: DataFrame,
    repairs: DataFrame,
    key: str,
    at: str,
    gap: str,
    sums: Mapping[str, str],
    services: Sequence[str],
    since: str,
    first_values: Mapping[str, str],
    pivots: Mapping[str, Sequence[str] | None],
    repair_line: str,
    repair_stay: str,
    order: Sequence[str],
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Counts, sums and first values of each entity's calls, and its repairs, in one row.

    ``sums`` maps number or flag columns to output names, ``services`` are flags added up
    to one total, ``first_values`` are taken from the row with the earliest ``since`` (then
    ``order``), ``pivots`` gives categories with their levels (``None`` finds them). Absent
    numbers are zero. All measures of the calls come from a single aggregate; only a category
    with too many levels for columns is counted on its own, as a sparse vector ``category: counts``.
    """
    names = {
        "calls": "calls", "gap": "mean_gap", "services": "services", "since_year": "first_year",
        "repairs": "repairs", "stays": "stays", **(names or {}),
    }
    kinds = dict(calls.dtypes)

    def number(col: str):
        value = as_column(col)
        return value.cast("bigint") if kinds[col] == "boolean" else value

    calls = known_rows(calls, [key])
    pivot_aggregates, vectors = [], []
    for col, col_levels in pivots.items():
        found = col_levels if col_levels is not None else wide_levels(calls, col)
        if found is None:
            vectors.append(_vectors(calls, key, col))
            continue
        pivot_aggregates += [F.count_if(as_column(col) == level).alias(f"{col}: {level}") for level in found]
    first_row = position([since, *order])
    offered = sum((F.coalesce(number(s), F.lit(0)) for s in services), F.lit(0).cast("bigint"))
    per_entity = calls.groupBy(key).agg(
        F.count(as_column(at)).alias(names["calls"]),
        F.avg(F.coalesce(as_column(gap), F.lit(0))).alias(names["gap"]),
        *[F.coalesce(F.sum(number(c)), F.lit(0)).alias(n) for c, n in sums.items()],
        F.sum(offered).alias(names["services"]),
        F.coalesce(F.year(F.min(as_column(since))), F.lit(0)).alias(names["since_year"]),
        F.min_by(F.struct(*[as_column(c).alias(n) for c, n in first_values.items()]), first_row).alias("_first"),
        *pivot_aggregates,
    )
    per_entity = per_entity.select(
        *[as_column(c) for c in per_entity.columns if c != "_first"],
        *[F.col("_first")[n].alias(n) for n in first_values.values()],
    )
    per_repaired = (
        known_rows(repairs, [key])
        .groupBy(key)
        .agg(
            F.count(as_column(repair_line)).alias(names["repairs"]),
            F.count_distinct(as_column(repair_stay)).alias(names["stays"]),
        )
    )
    joined = per_entity.join(per_repaired, key, "left")
    for vector in vectors:
        joined = joined.join(vector, key, "left")
    return joined.fillna(0, subset=[names["repairs"], names["stays"]])


def any_per_entity(df: DataFrame, key: str, flag: str, name: str) -> DataFrame:
    """Does the flag hold in any of the entity's rows?"""
    return known_rows(df, [key]).groupBy(key).agg(F.coalesce(F.bool_or(holds(as_column(flag))), F.lit(False)).alias(name))
