"""Finding hot keys, and joins that spread them.

Adaptive execution splits a skewed join partition only if both sides come straight from a
shuffle. Joining rows with something aggregated by the same key is not such a case, and it
is the usual one here, so these joins salt the keys that need it.

Finding costs a row count, and only if there are more rows than one group may have, a pass
over a small sample of the keys. Sizes: a key is hot if it has more than
``max(max_group_rows, rows / MAX_SLICES)`` rows, so there are at most ``MAX_SLICES`` hot keys
however large the table is. Their list is the only thing collected or broadcast. It decides
how the work is split, never the result, so an estimate will do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_GROUP_ROWS = 5_000_000
MAX_SLICES = 5_000
NULL_PARTS = 4096
# Rows of the sample that a group at the limit would have.
SAMPLED_ROWS = 1_000


@dataclass(frozen=True)
class Sizes:
    """Where the sizes of groups come from if the rows are costly to derive.

    ``rows`` has about as many rows and is cheap to count; ``sample`` gives the key columns of
    about a share of them, drawn before the costly steps.
    """

    rows: DataFrame
    sample: Callable[[float], DataFrame]


def hot_keys(rows: DataFrame | Sizes, keys: Sequence[str], max_group_rows: int) -> tuple[DataFrame | None, int]:
    """Keys with too many rows, each with the number of parts it makes, and the limit.

    Nothing if no group is too large. A hot group without a key counts but is not listed.
    """
    table = rows.rows if isinstance(rows, Sizes) else rows
    total = table.count()
    limit = max(max_group_rows, -(-total // MAX_SLICES))
    if total <= limit:
        return None, limit
    share = min(1.0, SAMPLED_ROWS / limit)
    if isinstance(rows, Sizes):
        seen = rows.sample(share).select(*keys)
    else:
        seen = rows.select(*keys)
        if share < 1.0:
            seen = seen.sample(share, seed=17)
    sizes = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.filter(F.col("_rows") > limit * share).select(
        *keys, F.ceil(F.col("_rows") / F.lit(limit * share)).cast("int").alias("_parts")
    )
    found = hot.orderBy(F.col("_parts").desc()).limit(MAX_SLICES).collect()
    if not found:
        return None, limit
    known = [row for row in found if all(value is not None for value in row)]
    return table.sparkSession.createDataFrame(known, hot.schema), limit


def _hashable(df: DataFrame) -> list[str]:
    return [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_group_rows: int = MAX_GROUP_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Equi join of rows with a table that has few rows per key, whatever the skew of the rows.

    Hot keys of ``left`` are spread over as many parts as they need and their rows in
    ``right`` repeated for each. ``sizes_from`` may name a cheaper table with about as many
    rows per key as ``left``.
    """
    on = list(on)
    hot, _ = hot_keys(left if sizes_from is None else sizes_from, on, max_group_rows)
    added = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in on]
    kept = [F.col(f"`{c}`") for c in (*left.columns, *added)]
    if hot is None:
        return left.join(right, on, how).select(*kept)
    hot = F.broadcast(hot)
    # Equal rows differ at least in the partition they come from.
    scatter = F.xxhash64(*_hashable(left), F.spark_partition_id())
    part = F.pmod(scatter, F.coalesce("_parts", F.lit(1)))
    for key in on:
        part = F.when(F.col(key).isNull(), F.pmod(scatter, F.lit(NULL_PARTS))).otherwise(part)
    salted = left.join(hot, on, "left").withColumn("_salt", part.cast("int")).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    repeated = right.join(hot, on, "left").withColumn("_salt", copies).drop("_parts")
    return salted.join(repeated, [*on, "_salt"], how).select(*kept)
