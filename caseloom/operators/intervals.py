"""Points inside intervals, by key.

Joining points with intervals on the key alone pairs every point of a key with every
interval of it. Here time is cut into buckets. Of the intervals that start on one day the longest
stands for all; intervals are cut at the ends of the buckets, and of pieces that cover the same stretch only the
earliest start and the latest interval matter. So a key has at most 2 * ``BUCKET`` pieces and
``BUCKET`` points that differ in a bucket, however many rows it has, and only these meet. Rows are
shuffled once per piece, hot keys are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.skew import MAX_GROUP_ROWS, spread_join

# Half days of a bucket, as a power of two.
BUCKET_BITS = 8
BUCKET = 2**BUCKET_BITS

# Every date of a calendar of 9999 years fits into these.
_SHIFT, _SPAN = 2**23, 2**24


def _half_day(day: Column) -> Column:
    """Even numbers are midnights, the odd ones after them the rest of the day."""
    return _days(day.cast("date")) * 2


def _days(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")


def _pack(start: Column, end: Column) -> Column:
    """Start and end as one number that sorts like the pair, which hashes faster than it."""
    return (_days(start) + _SHIFT) * _SPAN + (_days(end) + _SHIFT)


def _packed_end(packed: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (packed % _SPAN - _SHIFT).cast("int"))


def _bucket(half_day: Column) -> Column:
    return F.shiftright(half_day, BUCKET_BITS)


def point_in_interval(
    points: DataFrame,
    intervals: DataFrame,
    key: str,
    at: str,
    start: str,
    end: str,
    start_shift_days: int = 1,
    flag: str = "inside",
    max_group_rows: int = MAX_GROUP_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Points with ``start + shift < at < end`` of any interval of their key flagged.

    ``start`` and ``end`` are dates, ``at`` a timestamp. A point inside several intervals
    gets the earliest start and the end of the one that starts last (of those, the latest).
    ``sizes_from`` is handed to the join that brings the result back to the points.
    """
    spans = (
        intervals.select(F.col(key).alias("_key"), F.col(start).cast("date").alias("_s"), F.col(end).cast("date").alias("_e"))
        .filter(F.col("_key").isNotNull() & F.col("_s").isNotNull() & F.col("_e").isNotNull())
        .groupBy("_key", "_s")
        .agg(F.max("_e").alias("_e"))
    )
    # Both bounds are exclusive.
    lo, hi = _half_day(F.col("_s")) + F.lit(2 * start_shift_days + 1), _half_day(F.col("_e")) - 1
    first = F.shiftleft("_bucket", BUCKET_BITS)
    pieces = (
        spans.filter(lo <= hi)
        .select("_key", "_s", "_e", F.explode(F.sequence(_bucket(lo), _bucket(hi))).alias("_bucket"))
        .repartition("_key", "_bucket")
        .withColumns({"_lo": F.greatest(lo, first), "_hi": F.least(hi, first + (BUCKET - 1))})
        .groupBy("_key", "_bucket", "_lo", "_hi")
        .agg(F.min("_s").alias("_s"), F.max(_pack(F.col("_s"), F.col("_e"))).alias("_top"))
    )

    moment = F.col(at).cast("timestamp_ntz")
    midnight = moment.cast("date").cast("timestamp_ntz")
    point = _half_day(moment) + F.when(moment > midnight, 1).otherwise(0)
    placed = points.withColumns({"_key": F.col(key), "_point": point})
    base = points if sizes_from is None else sizes_from
    found = (
        placed.filter(F.col(key).isNotNull() & F.col("_point").isNotNull())
        .select(F.col(key).alias("_key"), _bucket(F.col("_point")).alias("_bucket"), "_point")
        .distinct()
        .repartition("_key", "_bucket")
        .join(pieces, ["_key", "_bucket"])
        .filter(F.col("_point").between(F.col("_lo"), F.col("_hi")))
        .groupBy("_key", "_bucket", "_point")
        .agg(F.min("_s").alias("_s"), F.max("_top").alias("_top"))
        .select("_key", "_point", "_s", "_top")
    )
    placed_keys = base.select(F.col(key).alias("_key"), point.alias("_point"))
    joined = spread_join(placed, found, ["_key", "_point"], "left", max_group_rows, placed_keys)
    return joined.select(
        *points.columns,
        F.col("_s").alias(start),
        _packed_end(F.col("_top")).alias(end),
        F.col("_s").isNotNull().alias(flag),
    )
