"""Column expressions for dates and times, all on zone-less timestamps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.clean import ColumnLike, as_column, holds

DAY_MICROS = 86_400_000_000

# Range of dates a 64-bit nanosecond clock can hold; dates beyond it are typing errors.
FIRST_DATE = dt.date(1677, 9, 22)
LAST_DATE = dt.date(2262, 4, 11)
# How the inputs write times of day and dates.
TIME_PATTERN = r"^(\d{1,2}):(\d{2})$"
DATE_FORMATS = ("d/M/yyyy", "yyyyMMdd")


def normalise_time(column: ColumnLike) -> Column:
    """``H:MM`` or ``HH:MM`` to ``HH:MM:00``; anything else is null."""
    column = as_column(column)
    hours = F.lpad(F.regexp_extract(column, TIME_PATTERN, 1), 2, "0")
    minutes = F.regexp_extract(column, TIME_PATTERN, 2)
    return F.when(column.rlike(TIME_PATTERN), F.concat(hours, F.lit(":"), minutes, F.lit(":00")))


def at_time(day: ColumnLike, time: ColumnLike) -> Column:
    """Timestamp of a day and a time of day written ``HH:MM`` or ``HH:MM:SS``."""
    parts = F.split(as_column(time), ":")
    hours, minutes, seconds = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    span = F.make_dt_interval(F.lit(0), hours, minutes, F.coalesce(seconds, F.lit(0)).cast("decimal(18,6)"))
    return as_column(day).cast("timestamp_ntz") + span


def parse_date(column: ColumnLike, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date by the first format that fits, null if none does or the date is impossible."""
    column = as_column(column)
    trials = [F.try_to_date(column, f) for f in formats]
    return F.coalesce(*[F.when(t.between(F.lit(FIRST_DATE), F.lit(LAST_DATE)), t) for t in trials])


def micros_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Microseconds from start to end."""
    start, end = (as_column(c).cast("timestamp_ntz") for c in (start, end))
    return F.timestamp_diff("MICROSECOND", start, end)


def floor_days(start: ColumnLike, end: ColumnLike) -> Column:
    """Days from start to end, rounded down also below zero."""
    return F.floor(micros_between(start, end) / F.lit(DAY_MICROS)).cast("bigint")


def minutes_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Whole minutes from start to end, null unless at least one."""
    minutes = F.floor(micros_between(start, end) / F.lit(60_000_000)).cast("bigint")
    return F.when(minutes > 0, minutes)


def near_contract_edge(at: ColumnLike, start: ColumnLike, end: ColumnLike, days: int = 30) -> Column:
    """True in the first ``days`` after the start, the last ``days`` before the end, or later."""
    at, start, end = (as_column(c).cast("timestamp_ntz") for c in (at, start, end))
    span = F.make_dt_interval(F.lit(days))
    opening = holds(at >= start) & holds(at <= start + span)
    closing = holds(at >= end - span) | holds(at > end)
    return opening | closing
