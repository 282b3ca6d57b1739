"""Nearest match in time, by key.

Both tables are stacked and scanned once in time order: one shuffle and one sort, however
many rows either side has per key. Hot keys are cut into time slices by ``OrderedGroups``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.dates import DAY_MICROS, micros_between
from caseloom.operators.ordered import MAX_GROUP_ROWS, OrderedGroups


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by: Sequence[str],
    direction: str = "forward",
    tolerance: dt.timedelta | None = None,
    right_order: Sequence[str] = (),
    max_group_rows: int = MAX_GROUP_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Left rows, each with the right row nearest in time, or nulls.

    ``forward`` looks at or after the left time, ``backward`` at or before it, ``nearest``
    both ways (an equal distance goes backward). The tolerance is inclusive. Among right
    rows at one time, ``forward`` takes the first and ``backward`` the last in
    ``right_order``, which must make them unique. Rows without key or time match nothing.
    ``sizes_from`` is handed to :class:`OrderedGroups`.
    """
    if direction == "nearest":
        return _nearest(left, right, left_time, right_time, by, tolerance, right_order, max_group_rows)
    if direction not in ("forward", "backward"):
        raise ValueError(f"unknown direction {direction!r}")
    forward = direction == "forward"
    added = [c for c in right.columns if c not in by]
    clash = set(added) & set(left.columns)
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")

    # Columns of the key are the same in a whole group; the others lie in the match, so they are not sent twice.
    ties = [f"_match.`{o}`" for o in right_order if o not in by]
    match_type = right.select(F.struct(*added).alias("m")).schema["m"].dataType
    here_type = left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType
    # At one time, the scan has to meet right rows before left rows.
    stacked_left = left.select(
        *by,
        F.col(left_time).cast("timestamp_ntz").alias("_at"),
        F.lit(0 if forward else 1).alias("_side"),
        F.struct(*left.columns).alias("_here"),
        F.lit(None).cast(match_type).alias("_match"),
    )
    stacked_right = right.filter(F.col(right_time).isNotNull()).select(
        *by,
        F.col(right_time).cast("timestamp_ntz").alias("_at"),
        F.lit(1 if forward else 0).alias("_side"),
        F.lit(None).cast(here_type).alias("_here"),
        F.struct(*added).alias("_match"),
    )
    for key in by:
        stacked_right = stacked_right.filter(F.col(key).isNotNull())
    scan = OrderedGroups(
        stacked_left.unionByName(stacked_right),
        by,
        ["_at", "_side", *ties],
        descending=forward,
        max_group_rows=max_group_rows,
        sizes_from=sizes_from,
    )
    found = scan.last_known("_found", "_match").result().filter(F.col("_here").isNotNull())

    hit = F.col("_at").isNotNull() & F.col("_found").isNotNull()
    if tolerance is not None:
        distance = F.abs(micros_between("_at", F.col("_found")[right_time]))
        hit = hit & (distance <= F.lit(round(tolerance.total_seconds() * 1_000_000)))
    return found.select(
        *[F.col("_here")[c].alias(c) for c in left.columns],
        *[F.when(hit, F.col("_found")[c]).alias(c) for c in added],
    )


def _nearest(left, right, left_time, right_time, by, tolerance, right_order, max_group_rows) -> DataFrame:
    added = [c for c in right.columns if c not in by]
    before = right.select(*by, *[F.col(c).alias(f"_b_{c}") for c in added])
    after = right.select(*by, *[F.col(c).alias(f"_a_{c}") for c in added])
    both, keys = left, left.select(*by).unionByName(right.select(*by))
    for side, prefix, direction in ((before, "_b_", "backward"), (after, "_a_", "forward")):
        both = asof_join(
            both,
            side,
            left_time,
            prefix + right_time,
            by,
            direction,
            tolerance,
            [o if o in by else prefix + o for o in right_order],
            max_group_rows,
            keys,
        )
    back = micros_between(f"_b_{right_time}", left_time)
    ahead = micros_between(left_time, f"_a_{right_time}")
    use_back = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    return both.select(
        *left.columns, *[F.when(use_back, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in added]
    )


def asof_sweep(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by: Sequence[str],
    tolerances: Sequence[int],
    right_order: Sequence[str] = (),
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Number of forward matches for each tolerance in days: ``tolerance_days``, ``matches``.

    The nearest row does not depend on the tolerance, so one join serves all of them.
    """
    matched = asof_join(
        left.select(*by, left_time),
        right.select(*by, right_time, *[o for o in right_order if o not in (*by, right_time)]),
        left_time,
        right_time,
        by,
        "forward",
        dt.timedelta(days=max(tolerances)),
        right_order,
        max_group_rows,
    )
    gap = micros_between(left_time, right_time)
    counts = matched.agg(*[F.count_if(gap <= F.lit(t * DAY_MICROS)).alias(str(t)) for t in tolerances])
    rows = F.explode(
        F.array(*[F.struct(F.lit(t).alias("tolerance_days"), F.col(str(t)).alias("matches")) for t in tolerances])
    )
    return counts.select(rows.alias("r")).select("r.tolerance_days", "r.matches")
