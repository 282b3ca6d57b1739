"""Reading, harmonising and writing tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column that keeps the position of a row in its source, see :func:`read_harmonised`.
SOURCE_ORDER = "_src"


def _typed(name: str, kind: T.DataType, have: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    return column.try_cast(kind) if have != kind else column


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns in its order; bad values and missing columns become null."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            (_typed(f.name, f.dataType, have[f.name]) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def _load(spark: SparkSession, path: str, fmt: str, na_values: str | None = None) -> DataFrame:
    if fmt == "csv":
        options = {"header": "true", "multiLine": "false", "escape": '"'}
        if na_values is not None:
            options["nullValue"] = na_values
        return spark.read.options(**options).csv(path)
    return spark.read.format(fmt).load(path)


def _source_order(position: int, fmt: str) -> Column:
    """Sortable position: input, file, offset of the split in it, row within the split."""
    row = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
    return F.struct(
        F.lit(position).alias("input"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        row.alias("row"),
    ).alias(SOURCE_ORDER)


def read_harmonised(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType | None = None,
    renames: Mapping[str, str] | None = None,
    drops: Iterable[str] = (),
    fmt: str = "parquet",
    keep_order: bool = False,
) -> DataFrame:
    """Read same-topic inputs whose schemas drifted and stack them by column name.

    Each input is renamed and trimmed by itself; columns an input lacks are null. With
    ``keep_order`` a sortable column ``_src`` remembers where each row came from.
    """
    parts = []
    for position, path in enumerate(paths):
        part = _load(spark, path, fmt)
        order = [_source_order(position, fmt)] if keep_order else []
        part = part.select("*", *order).withColumnsRenamed(dict(renames or {})).drop(*drops)
        if schema is not None:
            part = conform(part, T.StructType([*schema.fields, *([part.schema[SOURCE_ORDER]] if keep_order else [])]))
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read one table and give it its declared types."""
    df = _load(spark, path, fmt)
    return df if schema is None else conform(df, schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, na_values: str | None = None) -> DataFrame:
    """Read a delimited file with a header line, ``na_values`` standing for null."""
    df = _load(spark, path, "csv", na_values)
    return df if schema is None else conform(df, schema)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), compression: str | None = None
) -> str:
    """Write a table, replacing what is there, and return its path."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    if compression is not None:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def _is_whole(column: Column) -> Column:
    return column.try_cast("double") == F.floor(column.try_cast("double"))


# Tried from the narrowest type on; every non-null text must fit.
_TEXT_CANDIDATES = (
    ("bigint", r"^[+-]?\d{1,18}$"),
    ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
    ("boolean", r"^(?i)(true|false)$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("timestamp_ntz", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"),
)


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Give text and double columns the narrowest type that holds all their values.

    One aggregate decides for all columns together; only its counts reach the driver.
    """
    fields = [f for f in df.schema.fields if (cols is None or f.name in cols)]
    checks: list[Column] = []
    options: dict[str, list[str]] = {}
    for f in fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            trials = {
                kind: column.rlike(pattern) & column.try_cast(kind).isNotNull() for kind, pattern in _TEXT_CANDIDATES
            }
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            trials = {"bigint": _is_whole(column) & column.try_cast("bigint").isNotNull()}
        else:
            continue
        options[f.name] = list(trials)
        checks.append(F.count(column).alias(f"{f.name}|n"))
        checks.extend(F.count_if(test).alias(f"{f.name}|{kind}") for kind, test in trials.items())
    if not checks:
        return df
    seen = df.agg(*checks).first().asDict()
    chosen = {}
    for name, kinds in options.items():
        fitting = [k for k in kinds if seen[f"{name}|n"] and seen[f"{name}|{k}"] == seen[f"{name}|n"]]
        if fitting:
            chosen[name] = F.col(f"`{name}`").try_cast(fitting[0])
    return df.withColumns(chosen) if chosen else df
